"""See the README for the operator list of this subpackage."""
