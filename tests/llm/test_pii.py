"""Personal data: base spans against the plain patterns, contexts by example, long texts, redaction."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import time

from chalkline.llm import pii


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(part) <= 255 for part in found.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, kind in enumerate(PLAIN) for m in re.finditer(PLAIN[kind], text) if passes(kind, m.group())]
    return [f"{list(PLAIN)[k]}:{a}:{b}" for a, k, b in sorted(found)]


def test_base_spans_of_odd_texts(spark, docs, nothing, texts):
    random.seed(9)
    parts = ["a", "@", ".", "-", "b.c", "_", "+", "1", "25", "300", " ", "(", ")", "4111111111111111", "é", "😀", "+1 017 555 7713", "x@y.z", "10.0.0.1", "\n"]
    odd = [(1000 + i, "".join(random.choice(parts) for _ in range(random.randint(1, 14)))) for i in range(1500)]
    rows = [*odd, *texts, (3000, "x" * 30000 + "@"), (3001, "9" * 3000), (3002, "1." * 2000)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    rows_found = pii.report(table).collect()
    found = collections.Counter((r["doc_id"], r["base_sha256"], *(r[f"n_{kind}"] for kind in PLAIN)) for r in rows_found)
    want = collections.Counter()
    for i, t in rows:
        spans = base_spans(t or "")
        want[i, sha(",".join(spans)), *(sum(s.startswith(f"{kind}:") for s in spans) for kind in PLAIN)] += 1
    assert found == want
    assert pii.report(nothing).count() == 0


def test_contexts_find_unseen_identifiers_and_redaction_hides_all(spark):
    rows = [(i, f"please write to user{i}x@mail{i}.org today") for i in range(6)]
    rows += [(10, "please write to user4711-at-home today"), (11, "the years 1998 and 20000 were long"), (12, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.report(table).collect()}
    assert spans[10] == "email:16:32" and spans[11] == spans[12] == ""
    hidden = {r["doc_id"]: r["text"] for r in pii.redact(table).collect()}
    assert hidden[3] == "please write to <EMAIL> today" == hidden[10]
    assert hidden[11] == rows[7][1] and hidden[12] is None


def test_contexts_on_both_sides_of_candidates_of_all_shapes(spark):
    rows = [(i, f"you can reach us at +1 017 555 77{i}{i} or +1 018 555 66{i}{i} during office hours") for i in range(9)]
    rows += [(20 + i, f"Phone: +1 019 555 88{i}{i}") for i in range(9)]
    rows += [(40 + i, f"please mail to user{i}x@mail{i}.org soon") for i in range(9)]
    unknown = [
        ("us at ", "5551234567"), ("us at ", "(555) 123-4567"), ("we said us at ", "555 123 4567"), ("Phone: ", "5552345678"),
        ("us at 5551234567 or ", "5559876543"), ("in 1998 please mail to ", "jane.doe(at)corp.com"), ("mail to ", "jo at corp dot com"),
        ("", "555 4321 987", " during office hours"),
    ]
    rows += [(100 + i, "".join(x)) for i, x in enumerate(unknown)]
    spans = {r["doc_id"]: r["spans"].split(",") for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (left, value, *_) in enumerate(unknown):
        kind = "email" if "corp" in value else "phone"
        assert f"{kind}:{len(left)}:{len(left) + len(value)}" in spans[100 + i], (left, value, spans[100 + i])


def test_contexts_are_followed_until_nothing_new_is_found(spark):
    rows, stages = [], ["zero", "one", "two", "three", "four", "five", "six", "seven"]
    for k, word in enumerate(stages):  # each leads to the next stage's numbers once its own are known
        rows += [f"call {word} +1 017 555 {k}{i:03d}" for i in range(20)]
        rows += [f"call {word} {k}000{i}99" for i in range(4) if k]
        rows += [f"call {word} {k + 1}000{i}99" for i in range(4)]
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.report(table).collect()}
    assert all(spans[i].startswith("phone:") for i in range(len(rows)))


def test_long_texts_take_time_in_proportion(spark):
    random.seed(2)
    tokens = [random.choice(["10.0.0.{}", "a{}@b.org", "{}12345", "+1 017 555 77{}", "word{}"]).format(i % 100) for i in range(100_000)]
    text = " ".join(tokens)
    start = time.perf_counter()
    table = spark.createDataFrame([(1, text), (2, " ".join(tokens[:10]))], "doc_id long, text string").repartition(2)
    found = {r["doc_id"]: r for r in pii.report(table).collect()}
    hidden = {r["doc_id"]: r["text"] for r in pii.redact(table).collect()}
    assert time.perf_counter() - start < 120
    base = base_spans(text)
    assert found[1]["base_sha256"] == sha(",".join(base))
    assert set(base) <= set(found[1]["spans"].split(","))
    assert hidden[1] == redacted(text, found[1]["spans"]) and hidden[2] == redacted(" ".join(tokens[:10]), found[2]["spans"])


def redacted(text, spans):
    out, end = [], 0
    for kind, a, b in (s.split(":") for s in spans.split(",") if s):
        if int(a) >= end:
            out += [text[end : int(a)], f"<{kind.upper()}>"]
        end = max(end, int(b))
    return "".join([*out, text[end:]])


def test_redaction_of_odd_texts_and_columns(spark):
    random.seed(4)
    parts = ["é", "😀" * 600, "+1 (017) 555-7713", " 4111 1111 1111 1111", "x@y.zz", "10.0.0.1", " ", "\n", "n" * 700, "+4111111111111111"]
    names = ["row", "body", "hit", "spans", "digest", "key", "cleaned", "text"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 9))) for _ in range(200)] + [None, ""]
    rows = [(*[f"{n}{i}" for n in names[:-1]], t) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    spans = {r["doc_id"]: r["spans"] for r in pii.report(table.withColumnRenamed("row", "doc_id")).collect()}
    found = pii.redact(table)
    assert found.columns == names
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(((*r[:-1], r[-1] and redacted(r[-1], spans[r[0]])) for r in rows), key=repr)
