"""Stages of the pipeline against plain Python on small tables."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{k % 2}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)], SCHEMA)


def near_rows():
    r = random.Random(3)
    text = lambda n: " ".join("".join(r.choices("abcdef", k=6)) for _ in range(n))
    a, b, c, d = text(80), text(80), text(80), text(80)
    # 1: its own text and a copy of 0's; 5: two linked texts of one id; null ids: two linked texts and one apart
    return [(0, a), (1, b), (1, a + " more"), (5, c), (5, c + " more"), (None, d), (None, d + " more"), (None, text(80)), (7, ""), (8, None), (0, a)]


def groups_of(rows):
    """Rows in order of id (null last), with the least row of each one's group; sets of 5-word shingles, 3/4."""
    docs = sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    return docs, root


def test_near_duplicates_leaves_one_of_a_group_with_repeated_or_null_ids(spark):
    rows = near_rows()
    docs, root = groups_of(rows)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, table(spark, rows), "").collect()]
    assert len(got) == len(set(got)) == len(set(root))
    kept = [root[docs.index(x)] for x in got]
    assert sorted(kept) == sorted(set(root))
    # the one kept has the group's smallest id
    assert all(x[0] == docs[k][0] for x, k in zip(got, kept, strict=True))


def test_line_dedup_keeps_what_is_left(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\n a\nb \n\nc\ny"), (3, "a\nb\nc"), (4, "a\nb"), (5, ""), (6, "b\nc\nd\n"), (7, None)]
    seen, want = set(), {}
    for i, t in rows:
        raw = (t or "").split("\n")
        content = [k for k, x in enumerate(raw) if x.strip()]
        gone = set()
        for j in range(len(content) - 2):
            run = tuple(raw[k].strip() for k in content[j : j + 3])
            if run in seen:
                gone |= set(content[j : j + 3])
            seen.add(run)
        left = None if t is None else "\n".join(x for k, x in enumerate(raw) if k not in gone)
        if not gone or left.strip():
            want[i] = (left, None if left is None else len(left))
    out = corpus_pipeline.line_dedup(spark, table(spark, rows), "").collect()
    assert len(out) == len(want) and {r["doc_id"]: (r["text"], r["n_chars"]) for r in out} == want
