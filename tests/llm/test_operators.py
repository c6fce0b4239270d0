"""Operators of the training-data subpackage against brute force on small tables with odd rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from palimpsest.llm import langid, lines, media, mixing, ngram_join, nn_descent, quality, suffix, warc

DOCS = "doc_id long, text string, lang string, source string, n_lines string, key string"


def words(r, n):
    return " ".join("".join(r.choices("abcdeé", k=r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    base = [words(r, 60) for _ in range(6)]
    texts = [None, "", "  \n ", "short text", "x" * 300, base[0], base[0]]
    for _ in range(40):
        own = base[r.randrange(6)].split()
        own[r.randrange(60)] = "changed" + str(r.random())
        texts.append(" ".join(own))
        texts.append("\n".join([words(r, 8), *r.sample(base, 1)[0].split(" ", 3)[:3], words(r, 5), words(r, 4)]))
    texts.append((base[1] + "\n") * 40)
    return [(i, t, "en" if i % 2 else None, None if i % 7 == 0 else f"s{i % 3}", "clash", "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3).cache()


def odd_rows(spark):
    return spark.createDataFrame([(None, None, None, None, None, None), (None, "a b", None, None, None, None), (1, "a b", "x", "s", "", ""), (1, "a b", "x", "s", "", ""), (1, "c d", "x", "s", "", "")], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


OPERATORS = {
    "lines": lines.dedup_lines,
    "mix": mixing.mix,
    "ngram": ngram_join.ngram_join,
    "suffix": suffix.remove_repeats,
    "media": lambda d: media.media_features(media.media_column(d)),
    "language": lambda d: langid.predict_languages(d, langid.learn_profiles(d)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_empty_tables(spark, name):
    assert OPERATORS[name](empty(spark)).count() == 0
    rows = OPERATORS[name](odd_rows(spark)).collect()
    assert len(rows) == 5 and sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "1", "None", "None"]


def test_suffix(docs, corpus):
    seen, want = set(), {}
    for i, t, *_ in corpus:
        t = (t or "").encode()
        cover = np.zeros(len(t), bool)
        for j in range(len(t) - 99):
            if t[j : j + 100] in seen:
                cover[j : j + 100] = True
            seen.add(t[j : j + 100])
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], cover.astype(int)])) == 1))
        want[i] = (len(t), int(cover.sum()), runs, hashlib.sha256(bytes(b for b, c in zip(t, cover, strict=True) if not c)).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in suffix.remove_repeats(docs).collect()} == want


def test_anchors_of_empty_and_short_texts():
    found = suffix.anchors([b"y" * 400, b"", b"z" * 99, b"y" * 150])
    assert found["i"].tolist().count(1) == 0 and found["n"].sum() == 301 + 51


def test_cover_ranks():
    r = random.Random(2)
    base = bytes(r.choices(b"ab", k=130))
    contexts = [base, b"c" * 20 + base[7:], base[:100]]
    row, offset = suffix.repeated_strings(contexts, np.zeros(3, np.int64), np.array([1, 2, 3]), np.zeros(3, np.int64), np.array([50, 63, 50]))
    assert set(zip(row.tolist(), offset.tolist(), strict=True)) == {(1, j) for j in range(20, 44)} | {(2, 0)}


def test_ngram(docs, corpus):
    sets = {}
    for i, t, *_ in corpus:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(docs).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_sketches_are_lower_bounds_and_bands_meet():
    r = np.random.default_rng(0)
    for n in (1, 2, 3, 5, 8, 20, 57, 200, 700):
        for _ in range(30):
            a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            b = a.copy()
            for _ in range(r.integers(0, 1 + 2 * n // 7)):
                b = b[np.arange(len(b)) != r.integers(0, len(b))] if r.random() < 0.5 and len(b) > 1 else np.unique(np.append(b, r.integers(0, 1 << 63).astype(np.uint64)))
            common = len(np.intersect1d(a, b))
            apart = len(a) + len(b) - 2 * common
            sa, sb = ngram_join.parity_sketch(a), ngram_join.parity_sketch(b)
            size = min(len(sa), len(sb)) // 8
            assert np.bitwise_count(ngram_join._fold(ngram_join._words_of([sa]), size) ^ ngram_join._fold(ngram_join._words_of([sb]), size)).sum() <= apart
            if 4 * common >= 3 * (len(a) + len(b) - common):
                assert np.intersect1d(ngram_join.band_words(a), ngram_join.band_words(b)).size


def test_lines(docs, corpus):
    seen, want = set(), {}
    for i, t, *_ in corpus:
        raw = (t or "").split("\n")
        content = [(k, x.strip()) for k, x in enumerate(raw) if x.strip()]
        gone = set()
        for j in range(len(content) - 2):
            run = tuple(x for _, x in content[j : j + 3])
            if run in seen:
                gone |= {k for k, _ in content[j : j + 3]}
            seen.add(run)
        want[i] = (None if t is None else "\n".join(x for k, x in enumerate(raw) if k not in gone), len(raw), len(gone))
    out = lines.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "key", "n_lines", "n_removed"]
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()} == want


def test_mix_comes_near_its_targets(docs):
    rows = mixing.mix(docs).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"] and len(r["positions"]) == r["copies"]
    for own in by.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
    assert sum(own[0]["target"] for own in by.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))
    place = [r["position"] for r in rows if r["position"] is not None]
    assert place == sorted(place)
    assert [tuple(r) for r in mixing.mix(docs).collect()] == [tuple(r) for r in rows]


def test_warc_rejects_magic_in_payloads(spark, tmp_path):
    inner = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "u", inner * 20), (2, "u\r\nX: y", inner * 20), (3, None, None), (None, "n", "é" * 600), (5, "v", "é" * 600), (6, "w", "small"), (7, "w", "small")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, path string")
    warc.write_warc(pages, str(tmp_path / "a"))
    got = {r["record_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, str(tmp_path / "a")).collect()}
    assert len(got) == 7
    for i, _, h in rows:
        h = (h or "").encode()
        other = {1: 2, None: 5}.get(i)
        assert got[i] == (len(h), hashlib.sha1(h).hexdigest(), "revisit" if other else "response", other)
    file = next((tmp_path / "a").glob("part-*"))
    (file.parent / f".{file.name}.crc").unlink()
    file.write_bytes(file.read_bytes()[:-9])
    with pytest.raises(Exception, match="breaks off"):
        warc.read_warc(spark, str(tmp_path / "a")).collect()
    assert warc.reached(np.array([0, 5, 9, 12]), np.array([9, 12, 12, 12])).tolist() == [True, False, True, True]


def test_png_filters_and_checksums():
    r = np.random.default_rng(3)
    rows = r.integers(0, 256, (6, 192), np.uint8)
    left = np.pad(rows, ((0, 0), (3, 0)))[:, :-3].astype(int)
    up = np.pad(rows, ((1, 0), (0, 0)))[:-1].astype(int)
    corner = np.pad(rows, ((1, 0), (3, 0)))[:-1, :-3].astype(int)
    p = left + up - corner
    near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
    guesses = [np.zeros_like(left), left, up, (left + up) // 2, near]
    kinds = [1, 2, 3, 4, 0, 4]
    coded = np.stack([(rows[i] - guesses[k][i]) % 256 for i, k in enumerate(kinds)]).astype(np.uint8)
    assert (media.unfilter(np.column_stack([np.array(kinds, np.uint8), coded]), 3) == rows).all()
    payload = rows.tobytes() * 3
    image = media.encode_png(payload)
    assert media.decode_png(image).tobytes() == payload
    for at in (20, len(image) // 2, len(image) - 3):
        bad = bytearray(image)
        bad[at] ^= 1
        with pytest.raises(media.CorruptImage):
            media.decode_png(bytes(bad))


def test_media(docs, corpus):
    got = {r["doc_id"]: r for r in OPERATORS["media"](docs).collect()}
    for i, t, *_ in corpus:
        b = (t or "").encode()
        p = b.ljust(max(1, -(-len(b) // 192)) * 192)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert got[5]["feature"] == got[6]["feature"]


def test_language(spark):
    r = random.Random(1)
    stems = {"aa": ["the", "ing", "an", "er"], "bb": ["sch", "ung", "ei", "ß"], "cc": ["ción", "os", "el", "ñ"]}
    text = lambda k: " ".join("".join(r.choices(stems[k], k=3)) for _ in range(60))
    rows = [(i, text(k), k) for i in range(60) for k in stems]
    learned = langid.learn_profiles(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    test = [(i, text(k), k) for i in range(10) for k in stems] + [(99, None, None), (98, "123 !", None)]
    got = langid.predict_languages(spark.createDataFrame(test, "doc_id long, text string, lang string"), learned).collect()
    assert all(g["lang_pred"] == (g["lang"] or "und") and 0 <= g["score"] <= 1 for g in got)
    word = collections.Counter({"abc": 2, "b": 1})
    v, c = langid._word_grams(word)
    flat = langid.counted(np.concatenate([langid.grams(langid.letters_only("abc")), langid.grams(langid.letters_only("abc")), langid.grams(langid.letters_only("b"))]))
    assert (v == flat[0]).all() and (c == flat[1]).all()


def test_quality(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        good, toxic = i % 3 > 0, i % 10 == 0
        t = words(r, 30) + (" slurword" if toxic else "")
        rows.append((i, t if good else t.upper().replace(" ", "!! "), f"h{i % 5}", None if i % 2 else "p"))
        labels.append((i, int(good), int(toxic)))
    docs = spark.createDataFrame([*rows, (None, None, None, None)], "doc_id long, text string, h string, p string")
    got = quality.classify(docs, spark.createDataFrame(labels[:300], "doc_id long, quality int, toxic int"), host="h", path="p").collect()
    assert len(got) == 401
    assert all(g["kept"] == (g["doc_id"] % 3 > 0 and g["doc_id"] % 10 != 0) for g in got if g["doc_id"] is not None and g["doc_id"] >= 300)
    none = quality.classify(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), host="h", path="p")
    assert none.count() == 401
    assert quality.classify(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), host="h", path="p").count() == 0


def test_vectors(spark):
    r = np.random.default_rng(5)
    centre = r.standard_normal(16)
    vectors = [(r.standard_normal(16)).tolist() for _ in range(150)] + [(centre + 0.05 * r.standard_normal(16)).tolist() for _ in range(60)] + [centre.tolist()] * 3
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None, 1.0]), (904, []), (905, [1.0, 2.0]), (None, [3.0, -1.0]), (0, rows[0][1])]
    out = nn_descent.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")).collect()
    assert len(out) == len(rows) + len(odd)
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    got = {o["vec_id"]: o for o in out}
    assert all(got[i]["n_links"] == near[i].sum() for i in range(len(rows)))
    assert all(got[i]["component_id"] == 150 for i in range(150, 213)) and got[150]["kept"] and not got[151]["kept"]
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 906)) and got[None]["component_id"] is None
    assert nn_descent.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
