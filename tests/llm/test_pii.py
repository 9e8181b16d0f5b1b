import hashlib
import random
import re
from collections import defaultdict
from math import log2

from folioforge.llm import catalog, pii

SF = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def fits(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    found = [(m.start(), i, m.end(), m[0]) for i, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if fits(kind, m[0])]
    return sorted(found)


def masked(text):
    for a, _, b, _ in base(text):
        text = text[:a] + " " * (b - a) + text[b:]
    return text


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b, *_ in spans)


def expected(rows):
    texts = [text or "" for _, text in rows]
    holders, having, own = defaultdict(set), defaultdict(set), []
    for text in texts:
        for term in re.findall(r"[^\W_]{2,}", masked(text).lower()):
            having[term].add(text)
        own.append({(k, value.lower() if k < 2 else re.sub("[^0-9]", "", value)) for _, k, _, value in base(text)})
        for entity in own[-1]:
            holders[entity].add(text)
    flagged, total = defaultdict(set), len(set(texts))
    for entity, held in holders.items():
        rate = len(held) / max(total, len(held) + 1)
        for term in {t for text in held for t in re.findall(r"[^\W_]{2,}", masked(text).lower())}:
            share = (len(held & having[term]) + pii.SHRINK * rate) / (len(having[term]) + pii.SHRINK)
            if share >= pii.LIKELY and 1 - log2(share) / log2(rate) >= pii.DISCLOSED:
                flagged[entity].add(term)
    out = []
    for (key, _), text, entities in zip(rows, texts, own, strict=True):
        found, terms = base(text), set().union(*[flagged[e] for e in entities]) & set(re.findall(r"[^\W_]{2,}", masked(text).lower()))
        more = [(m.start(), 4, m.end()) for m in re.finditer(rf"(?i)(?<![^\W_])(?:{'|'.join(sorted(terms))})(?![^\W_])", masked(text))] if terms else []
        out.append((key, *(sum(s[1] == k for s in found) for k in range(4)), hashlib.sha256(listed(found).encode()).hexdigest(), listed(sorted([*(s[:3] for s in found), *more]))))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = catalog.op10_pii(spark, SF)
    assert found.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert rows_of(found) == expected([(r.doc_id, r.text) for r in docs.collect()])


def odd_rows():
    card = "4111 1111 1111 1111"
    rows = [
        (1, None), (2, ""), (3, "a@b.c_d@e.f.g x@y 🙂 p@q.r"), (4, "1.2.3.4.5.6.7.8 256.1.1.1 0255.00.1.1 1.2.3"), (5, f"{card} 4111-1111-1111-1112 {card}0"),
        (6, "+1 (555) 555-0100x +12 +1.2.3.4.5.6.7.8.9.0.1.2.3.4.5.6 ++49 30 1234567"), (7, "9" * 30000), (8, "x" * 60000 + "@a.b"), (9, "1" * 20000 + ".1.1.1"), (None, "+1 555 555 0100 漢字 a@é.b"),
        (10, "a@b" + ".c" * 20000), (11, "0 0-0" * 3000), (12, "+" * 5000 + "1" * 11),
    ]
    for i in range(5):  # a term that gives an entity away, next to common words
        rows.append((20 + i, f"note {i} with words: Zorblatt called boss@corp.example about number {i} again, and zorblatt left"))
    rows += [(30 + i, f"note with words about number {i} again called and left") for i in range(40)]
    return rows + [(20, rows[-40 - 5][1])] * 2


def test_odd_rows(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, value int")
    found = rows_of(pii.report(docs))
    assert found == expected(rows)
    assert any("term:" in r[-1] for r in found) and not any("term:" in r[-1] for r in found if r[0] and r[0] >= 30)
    assert pii.report(docs.limit(0)).collect() == []
    clean = pii.sanitised(docs)
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[3] == "[EMAIL][EMAIL] x@y 🙂 [EMAIL]" and texts[1] is None and texts[30] == rows[18][1]
    assert texts[21] == "note 1 with words: [TERM] called [EMAIL] about number 1 again, and [TERM] left"


def test_clashing_names(spark):
    rows = odd_rows()
    names = ["pii_print", "pii_more", "pii_spans", "print", "doc", "text_"]
    docs = spark.createDataFrame([(*r, *names) for r in rows], ["doc_id", "text", *names])
    clean = pii.sanitised(docs)
    assert clean.columns == docs.columns and {tuple(r)[2:] for r in clean.collect()} == {tuple(names)}
    plain = pii.sanitised(docs.select("doc_id", "text"))
    assert rows_of(clean.select("doc_id", "text")) == rows_of(plain)


def planted(names=40, plain=400):
    """Texts in which a name stands in the heading and its address at the end, two to four texts a name, far apart."""
    dice, words = random.Random(7), [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    filler = lambda: " ".join(dice.choices(words, k=60))
    rows, own = [], {}
    for i in range(names):
        name = ["Wu", "Ana", "漢字", "Zorblatt"][i % 4] + str(i) * (i > 3)
        for _ in range(2 + i % 3):
            own[len(rows)] = name.lower()
            rows.append((len(rows), f"{name} writes: {filler()} mail to box{i}@corp.example"))
    return rows + [(len(rows) + i, filler()) for i in range(plain)], own


def test_no_term_inside_a_base_span(spark):
    rows = [(i, f"zed writes from zed.quux@foo.org, {i}" if i < 3 else f"quux foo plain {i}") for i in range(100)]
    found = rows_of(pii.report(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == expected(rows)
    assert all(r[-1] == "term:0:3,term:4:10,term:11:15,email:16:32" for r in found if r[0] < 3)


def test_names_far_from_their_address(spark):
    rows, own = planted()
    found = rows_of(pii.report(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == expected(rows)
    hidden = {}
    for key, *_, spans in found:
        text = rows[key][1].lower()
        hidden[key] = {text[int(a) : int(b)] for kind, a, b in (x.split(":") for x in spans.split(",") if x) if kind == "term"}
    assert all(name in hidden[key] for key, name in own.items())
    assert all(not hidden[key] for key, _ in rows if key not in own)
    assert not any(re.match("word", t) for terms in hidden.values() for t in terms)


def test_one_group_holds_most_texts(spark):
    """A third of all texts shares many addresses and words; copies of one text are another third."""
    boxes = " ".join(f"b{i}@c.de" for i in range(60))
    rows = [(i, f"{boxes} common words secretword{i % 2} here {i}") for i in range(60)] + [(100 + i, f"copy x{1}y a@b.cd") for i in range(60)] + [(200 + i, f"common words here {i}") for i in range(60)]
    assert rows_of(pii.report(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(rows)
