"""Each operator against a brute-force version, an exact round trip, or held-out accuracy; edge cases included."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from etlscope.llm import chat, components, decontam, fingerprint, learning, mixing, neardup, quality, queries, simhash, similar, substring, tokens, toxicity, util, warc

SF = "/root/testdata/sf0.001"
SPACE, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {ord(a): ord(b) for a, b in zip(util.UPPER, util.LOWER, strict=True)}
#: Nulls, empty and long texts, repeated rows, equal ids, and columns whose names clash with the operators' own.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "Ein Wort"), (4, "Ein Wort"), (4, "anders"), (None, "ohne Nummer"), (5, "lang " * 20000), (6, "é ß 中 " * 30), (7, "é ß 中 " * 30)]


@pytest.fixture(scope="module")
def docs(spark):
    return util.table(spark, SF, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "src", len(t or ""), 0.5, "x", 1, 2, 3, 4, 5, 6, 7, 8, 9) for i, t in ODD]
    names = "doc_id long, Text string, lang string, source string, n_chars long, score double, fp string, rid int, h int, threshold int, _mix_tokens int, _MIX_source int, _mix_selected int, y int, probability int, words int"
    return spark.createDataFrame(rows, names)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def ids_texts(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


# --- near-duplicates and fingerprints -----------------------------------------------------------------------------


def simhash3(text):
    w = SPACE.findall((text or "").translate(LOWER))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = np.array([xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s], np.uint64)
    if not len(h):
        return 0
    votes = ((h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(0)
    return sum(1 << i for i in range(64) if votes[i] * 2 > len(h))


def linked(prints, radius):
    """Components by brute force: index -> index of its least member."""
    a, parent = np.array(prints, np.uint64), list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= radius) + i + 1:
            p, q = find(i), find(int(j))
            parent[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(a))]


@pytest.mark.parametrize("crowd", [1, 128])
def test_near_duplicates(docs, crowd):
    texts = sorted(ids_texts(docs))
    prints = [simhash3(t) for _, t in texts]
    roots = linked(prints, 2)
    want = sorted(((i, f"{p:016x}", texts[r][0]) for (i, _), p, r in zip(texts, prints, roots, strict=True)), key=str)
    got = neardup.near_duplicates(docs, crowd=crowd)
    assert rows(got.select("doc_id", simhash.hex16(got["fp"]), "component_id"), "*") == want


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_dense_cluster(spark, radius):
    random.seed(5)
    prints = list({0, *[sum(1 << b for b in random.sample(range(64), random.randint(radius // 2, 4 + radius))) for _ in range(300 if radius < 3 else 60)]})
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    want = linked(prints, radius)
    for crowd in (0, 5, 1000) if radius < 3 else (0, 1000):
        edges = neardup.pigeonring_links(spark.createDataFrame(signed, "fp long"), radius, 5, crowd)
        roots = {r["node"]: r["root"] for r in components.connected(edges).collect()}
        got = collections.defaultdict(set)
        for (s,), w in zip(signed, want, strict=True):
            got[roots.get(s, s)].add(w)
        assert all(len(x) == 1 for x in got.values()) and len(got) == len(set(want))


def test_keep_one(odd):
    assert neardup.near_duplicates(odd).count() == len(ODD) and neardup.query(odd).columns == ["doc_id", "fingerprint", "component_id"]
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 4, 4, 5, 6]


def shingles5(text):
    w = SPACE.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


@pytest.fixture(scope="module")
def edited(spark):
    """Texts of 20 to 400 words with copies in which a few words are replaced, some just above and some below 0.8."""
    random.seed(11)
    texts = []
    for _ in range(60):
        base = [f"w{random.randrange(5000)}" for _ in range(random.choice([20, 60, 150, 400]))]
        texts.append(" ".join(base))
        for n in (1, len(base) // 60, len(base) // 50, len(base) // 40, len(base) // 25):
            copy = list(base)
            for at in random.sample(range(len(base)), n):
                copy[at] = f"x{random.randrange(5000)}"
            texts.append(" ".join(copy))
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("crowd", [1, 32])
def test_stage_links_all_of_similarity(edited, spark, crowd):
    import corpus_pipeline

    sets = [shingles5(t) for _, t in sorted(ids_texts(edited))]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            if i // 6 == j // 6 and jaccard(sets[i], sets[j]) >= 0.8:
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    want = {i for i in range(len(sets)) if find(i) == i}
    assert len(want) < 0.7 * len(sets)
    got = {r[0] for r in (corpus_pipeline.near_dedup(spark, edited, SF) if crowd == 32 else similar.keep_one(edited, crowd=crowd)).select("doc_id").collect()}
    assert want <= got and len(got - want) <= 0.01 * len(sets)


def test_stage_takes_candidates_from_simhash(edited, spark, monkeypatch):
    """Without MinHash bands the stage still links what op7's fingerprints link, as far as it is similar enough."""
    import corpus_pipeline

    texts = sorted(ids_texts(edited))
    sets, prints = [shingles5(t) for _, t in texts], [simhash3(t) for _, t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2 and jaccard(sets[i], sets[j]) >= 0.8]
    assert any(sets[i] != sets[j] for i, j in pairs)
    monkeypatch.setattr(similar, "candidates", lambda classes, *_: classes.selectExpr("cls a", "cls b").limit(0))
    kept = {r[0] for r in corpus_pipeline.near_dedup(spark, edited, SF).select("doc_id").collect()}
    assert {i for i, _ in texts} - kept == {i for i, _ in pairs}


def test_stage_odd_rows(spark, odd):
    kept = similar.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 4, 4, 5, 6]
    assert similar.keep_one(odd.limit(0)).isEmpty()


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7), (3, 2)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_fingerprint_values(spark, docs):
    """Votes of every word pair, one bit at a time."""
    from pyspark.sql import functions as F

    own = docs.where("doc_id % 7 = 0")
    pairs = {(i, p) for i, t in ids_texts(own) for w in [SPACE.findall(t or "")] for p in (zip(w, w[1:], strict=False) if len(w) > 1 else [(x, None) for x in w])}
    terms = spark.createDataFrame(list({p for _, p in pairs}), "a string, b string").select("a", "b", F.xxhash64("a", "b").alias("h"))
    code = {(r["a"], r["b"]): r["h"] for r in terms.collect()}
    got = {r["doc_id"]: int(r["fingerprint"], 16) for r in fingerprint.query(own).collect()}
    for i, t in ids_texts(own):
        w = SPACE.findall(t or "")
        votes, total = [0] * 64, 0
        for a, b in zip(w, w[1:], strict=False) if len(w) > 1 else [(x, None) for x in w]:
            weight = min(fingerprint.MOST_WEIGHT, len(a.encode()) + len((b or "").encode()))
            total += weight
            for k in range(64):
                votes[k] += weight * (code[(a, b)] >> k & 1)
        assert got[i] == sum(1 << k for k in range(64) if 2 * votes[k] > total)


def test_fingerprints_of_equal_and_null_ids(odd):
    """Descending ids, null ones last; equal ones by the hash of the text, then by the text."""
    signed = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64((t or "").encode(), seed=42).intdigest())
    texts = sorted(((i, t or "") for i, t in ids_texts(odd)), key=lambda x: (x[0] is None, -(x[0] or 0), signed(x[1]), x[1]))
    want = []
    for k, (i, t) in enumerate(texts):
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + texts[(k + 1) % len(texts)][1][:half]).encode()).hexdigest()))
    assert rows(fingerprint.query(odd), "doc_id", "n_chars", "edited_sha256") == sorted(want, key=str)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_fingerprints(request, which):
    df = request.getfixturevalue(which)
    df = df.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = sorted(((i, t or "") for i, t in ids_texts(df)), reverse=True)
    got = {r["doc_id"]: r for r in fingerprint.query(df).collect()}
    prints = np.array([int(r["fingerprint"], 16) for r in got.values()], np.uint64)
    for k, (i, t) in enumerate(texts):
        following, half = texts[(k + 1) % len(texts)], len(t) // 2
        edited = t[: len(t) - half] + following[1][:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        own = int(got[i]["fingerprint"], 16)
        assert got[i]["near_next"] == pytest.approx(1 - (own ^ int(got[following[0]]["fingerprint"], 16)).bit_count() / 64)
        if i % 50 == 0:
            assert got[i]["n_near"] == (np.bitwise_count(prints ^ np.uint64(own)) <= 3).sum() - 1


# --- spans of words -----------------------------------------------------------------------------------------------


def repeats(texts, window):
    split = [(i, SPACE.findall(t or "")) for i, t in texts]
    count = collections.Counter(tuple(w[s : s + window]) for _, w in split for s in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if count[tuple(w[s : s + window])] > 1:
                gone[s : s + window] = [True] * window
        out.append((i, len(w), sum(gone), substring.digest([x for x, g in zip(w, gone, strict=True) if not g])))
    return sorted(out, key=str)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_substring_dedup(request, which):
    df = request.getfixturevalue(which)
    assert rows(substring.query(df), "*") == repeats(ids_texts(df), 35)


def thue_morse(n):
    """Two words of 2**n letters that polynomial hashes modulo 2**64 cannot tell apart from n = 10 on."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_that_polynomials_confuse(spark):
    from tokenizers import Tokenizer

    one, other = thue_morse(11)
    shared = [f"w{k}" for k in range(34)]
    texts = [(1, " ".join([*shared, one])), (2, " ".join([*shared, other])), (3, f"{one} {other}"), (4, f"{other} {one}")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert rows(substring.query(df), "*") == repeats(texts, 35)
    bench = spark.createDataFrame([(1, " ".join([*shared[:12], one]))], "item_id long, text string")
    assert rows(decontam.query(df, bench), *NAMES) == contaminated(texts, [tuple(r) for r in bench.collect()], 13)
    encode = Tokenizer.from_file(queries.tokenizer_path()).encode
    want = [(i, zlib.crc32(np.array([*encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t in texts]
    assert rows(tokens.query(df, queries.tokenizer_path()), "doc_id", "ids_crc32") == sorted(want, key=str)
    lone = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    assert similar.keep_one(lone).count() == 2


def test_substring_dedup_of_hot_passages(spark, monkeypatch):
    """Many groups, of which a task remembers few hashes; ids are strings."""
    monkeypatch.setattr(substring, "GROUP_BYTES", 600)
    random.seed(9)
    hot = " ".join(f"h{k}" for k in range(60))
    texts = [(f"d{i}", f"{' '.join(random.choices('abcdef', k=40))} {hot if i % 3 else ''} {i}") for i in range(120)]
    df = spark.createDataFrame(texts, "doc_id string, text string").coalesce(2)
    assert rows(substring.query(df), "*") == repeats(texts, 35)
    memory = substring.Memory(64)
    found = substring.distinct_hashes(np.array([5, 7, 7], np.uint64) << np.uint64(11), np.zeros(3, np.uint64))
    assert [memory.known(found).tolist() for _ in range(3)] == [[False, False], [False, False], [True, True]]


def test_substring_dedup_of_few_words(spark):
    random.seed(3)
    texts = [(i, random.choice([None, "", " ".join(random.choices(["a", "b", "é", "c1"], k=random.randint(1, 60))), "a " * 30])) for i in range(200)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for window, gram in ((5, 2), (6, 6), (9, 1)):
        got = substring.repeats(df, window, gram).selectExpr("doc_id", "n_words", "n_removed", "sha2(cast(kept as binary), 256)")
        assert rows(got, "*") == repeats(texts, window)


def contaminated(texts, items, window):
    windows = {}
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add("null" if i is None else str(i))
    sizes, out = {len(k) for k in windows}, []
    for i, t in texts:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = [False] * len(w), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if x := windows.get(tuple(w[s : s + n])):
                    found |= x
                    hit[s : s + n] = [True] * n
        out.append((i, len(w), sum(hit), len(found), decontam.items_digest(list(found)), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return sorted(out, key=str)


NAMES = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_decontamination(spark, request, which):
    df, bench = request.getfixturevalue(which), util.table(spark, SF, "benchmark")
    want = contaminated(ids_texts(df), [tuple(r) for r in bench.select("item_id", "text").collect()], 13)
    assert rows(decontam.query(df, bench), *NAMES) == want
    kept = decontam.remove_contaminated(df, bench)
    assert kept.columns == df.columns and rows(kept, "doc_id") == sorted(((r[0],) for r in want if not r[5]), key=str)


def test_removal_in_blocks_judges_rows_by_their_own_text(spark):
    passages = [" ".join(f"p{i}w{k}" for k in range(20)) for i in range(6)]
    bench = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    texts = [(1, passages[0]), (1, "clean one"), (None, passages[4]), (None, "clean two"), (None, None), (2, passages[5]), (2, "clean three"), (2, "clean three"), (3, "")]
    df = spark.createDataFrame([(i, t, f"s{k}") for k, (i, t) in enumerate(texts)], "doc_id long, text string, source string")
    whole = decontam.remove_contaminated(df, bench)
    assert whole.count() == 6
    for size in (200, 400):
        parts = decontam.remove_contaminated(df, bench, block_bytes=size)
        assert parts.columns == df.columns and rows(parts, "*") == rows(whole, "*")


def test_decontamination_of_few_words(spark):
    random.seed(4)
    texts = [(i, random.choice([None, "", "!!", " ".join(random.choices(["a", "B", "é", "c1"], k=random.randint(1, 60)))])) for i in range(150)]
    items = [(random.choice([None, i]), random.choice([None, "", " ".join(random.choices(["A", "b", "é"], k=random.randint(1, 9)))])) for i in range(12)]
    df, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 40):
        found = decontam.judge(decontam.matches(df, bench, 5, block)).selectExpr("doc_id", "n_words", "n_hit", "cast(size(items) as long)", "sha2(cast(concat_ws(',', items) as binary), 256)", "contaminated")
        assert rows(found, "*") == contaminated(texts, items, 5)


# --- formats ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", [8, 1])
@pytest.mark.parametrize("which", ["docs", "odd"])
def test_token_shards(request, which, kind):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    tokenizer, start, want = Tokenizer.from_file(queries.tokenizer_path()), 0, []
    encoded = [(i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in ids_texts(df)]
    got = tokens.query(df, queries.tokenizer_path(), kind).collect()
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == sorted(((i, len(x) // 4, zlib.crc32(x)) for i, x in encoded), key=str)
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
        want.append(r["doc_id"] if r["doc_id"] is not None else -1)
    assert want == sorted(want)


def test_token_pieces():
    import pyarrow as pa

    random.seed(5)
    alphabet = ["a", "B", " ", "  ", "\n", "\n\n", "\t", "é", "ß", "'s", "'", "1", "23", ".", "!?", " ", "　", "中", "\x85", "<|endoftext|>", "\r\n", "x", "×", "_"]
    encoder = tokens.Encoder(queries.tokenizer_path(), cache=50)
    for _ in range(100):
        texts = ["".join(random.choices(alphabet, k=random.randint(0, 40))) for _ in range(20)]
        if random.random() < 0.2:
            encoder.clear()
        ids, counts = encoder.encode(*tokens.tb.buffers(pa.array(texts)))
        for t, part in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert part.tolist() == [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2]


def test_token_reader_reads_one_document():
    writer = tokens.Writer(3, block=7)
    docs = [np.arange(n, dtype=np.uint32) * 70000 % 90001 for n in (5, 0, 40, 3)]
    parts = [writer.start()]
    for i, d in enumerate(docs):
        parts += list(writer.add(np.array([i]), np.array([False]), np.array([len(d)]), d))
    reader = tokens.Reader(b"".join(p + b"\n" for p in [*parts, *writer.finish()]))
    assert [reader.document(i).tolist() for i in range(4)] == [d.tolist() for d in docs]
    assert reader.digests() == [zlib.crc32(d.tobytes()) for d in docs]


def archived(pages):
    best = {}
    for i, _, h in pages:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            best[b] = max(best.get(b, i), i)
    out = []
    for i, _, h in pages:
        b = (h or "").encode()
        m = best.get(b) if len(b) >= 1000 else None
        again = m is not None and (i is None or i < m)
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", m if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc(spark, compression):
    odd = [(1, "u\r\nx", "é" * 600), (2, None, "é" * 600), (2, "b", "é" * 600), (None, "b", "é" * 600), (5, None, None), (6, "", ""), (7, "x", "WARC/1.1\r\n\r\n\r\n\r\nq"), (8, "x", "z\x00\r\n" * 9000), (None, "x", "ä\n" * 9000)]
    real = [tuple(r) for r in util.table(spark, SF, "pages").select("page_id", "url", "html").collect()]
    for pages in (odd, real):
        folder = util.new_folder(spark, "test-warc")
        warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), folder, segment_bytes=1000, compression=compression)
        got = warc.read_archives(spark, folder)
        assert rows(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == archived(pages)
        assert got.where("not intact").isEmpty() and not got.where("n_segments > 1").isEmpty()


def test_warc_members_are_plain_gzip(spark):
    import gzip

    folder = util.new_folder(spark, "test-warc-files")
    rows_ = [(i, f"http://h/{i}", "same " * 300 if i < 3 else f"<p>{i}</p>" * i) for i in range(40)]
    warc.write_archives(spark.createDataFrame(rows_, "page_id long, url string, html string").coalesce(2), folder, segment_bytes=700, compression="gzip")
    files = [bytes(r[0]) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content").collect()]
    for raw in files:
        parts = list(warc.members(memoryview(raw)))
        assert b"".join(parts) == gzip.decompress(raw) and all(len(list(warc.records_of(p))) == 1 for p in parts)
    heads = [f for raw in files for p in warc.members(memoryview(raw)) for f, _ in warc.records_of(p)]
    ids = {f["warc-record-id"] for f in heads if f["warc-type"] == "response"}
    refers = [f["warc-refers-to"] for f in heads if f["warc-type"] == "revisit"]
    assert len(refers) == 2 and set(refers) <= ids and "warcinfo" in {f["warc-type"] for f in heads}


def test_warc_reports_lost_segments():
    records = list(warc.page_records(1, "u", "x" * 500, hashlib.sha1(b"x" * 500).hexdigest(), None, "d", 200))
    parts = [(f, bytes(b)) for r in records for f, b in warc.records_of(memoryview(r + b"\r\n\r\n"))]
    rows_ = [{"number": int(f["warc-segment-number"]), "total": warc._whole(f.get("warc-segment-total-length")), "page_id": 1, "digest": hashlib.sha1(b"x" * 500).hexdigest(), "block": b} for f, b in parts]
    whole = lambda x: [r["intact"] for r in warc.reassemble(x)]
    assert whole(rows_[::-1]) == [True] and whole(rows_ + rows_) == [True, True]
    assert whole(rows_[:-1]) == [False] and whole(rows_[:1] + rows_[2:]) == [False] and whole(rows_ + rows_[:1]) == [False, False]
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\n\r\n") == b"abc" and warc.unchunked(b"9\r\nabc\r\n") is None


def spoken(turns):
    groups = collections.defaultdict(list)
    for c, t, r, x in turns:
        groups[c].append((t is not None, t or 0, r or "", x or ""))
    out = []
    for c, g in groups.items():
        g.sort()
        said = "".join(x for _, _, r, x in g if r == "assistant")
        out.append((c, len(g), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in g).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=str)


def test_chat_round_trip(spark):
    random.seed(4)
    pieces = ["<", "\\", "|end|>", "<|end|>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<\\s>", "a b", "é", "<|text|>", "\n", "<|turn|>", " "]
    turns = [(random.choice([None, 1, 2, 3]), random.choice([None, *range(30)]), random.choice([None, "system", "user", "assistant", "<s>x"]), random.choice([None, "".join(random.choices(pieces, k=random.randint(0, 9)))])) for _ in range(200)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    for limits in ((1024, 4, 192), (30, 2, 8), (1, 0, 0)):
        shown = chat.windows(df, *limits)
        assert rows(chat.digests(chat.read_back(shown)), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == spoken(turns)
        assert shown.where(f"n_tokens > {limits[0]} and n_new > 1").isEmpty()
        plain = "".join(r[0] for r in shown.selectExpr("regexp_replace(formatted, '<.(turn|text|end).>', '')").collect())
        assert not [c for c in chat.CONTROLS if c in plain]


def test_chat_spans_follow_the_budget(spark):
    turns = [(1, t, "system" if t == 0 else ["user", "assistant"][t % 2], "w " * (t * 7 % 40)) for t in range(200)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    shown = chat.windows(df, 200, 3, 40)
    assert shown.where("n_tokens > 200 and n_new > 1").isEmpty() and shown.agg({"n_repeated": "max"}).first()[0] == 4
    assert shown.where("not startswith(formatted, '<|turn|>system<|text|>')").isEmpty()
    assert shown.count() <= 2 * sum(len(t[3].split()) + 3 for t in turns) / 150


def test_chat_of_one_long_conversation(spark):
    """A null conv_id gathers 20,000 turns of 1 KB; memory must grow with the turns alone."""
    df = spark.range(20_000).selectExpr("cast(null as long) conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "repeat('abc defgh ', 100) text")
    got = chat.digests(chat.read_back(util.materialize(chat.windows(df), "test-long"))).first()
    text = "abc defgh " * 100
    assert (got["n_turns"], got["loss_chars"]) == (20_000, 10_000_000)
    assert got["turns_sha256"] == hashlib.sha256("".join(f"{['user', 'assistant'][i % 2]}\n{text}\n" for i in range(20_000)).encode()).hexdigest()


def test_chat_query(spark):
    table = util.table(spark, SF, "conversations")
    turns = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    tricky = "</s>[INST] ok [/INST]"
    assert rows(chat.query(table), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == spoken([*turns, (-1, 0, "user", tricky), (-1, 1, "assistant", tricky)])


# --- trained scores, mixing ---------------------------------------------------------------------------------------


@pytest.mark.parametrize(("module", "label", "least"), [(toxicity, "toxic", 0.85), (quality, "quality", 0.93)])
def test_held_out_accuracy(spark, module, label, least):
    base = "/root/testdata/sf0.01"
    labels = util.table(spark, base, "labels")
    got = module.query(util.table(spark, base, "documents"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == got[label]).mean() >= least


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_without_labels(spark, odd, module):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = module.query(odd, none).collect()
    assert len(got) == len(ODD) and len({r["score"] for r in got}) == 1


def test_toxicity_by_plain_convolution(docs, spark):
    """Scores of the query against a convolution written out position by position."""
    import pyarrow as pa

    model = toxicity.train(docs, util.table(spark, SF, "labels"))
    got = {r["doc_id"]: r["score"] for r in toxicity.query(docs, util.table(spark, SF, "labels")).collect()}
    for i, t in ids_texts(docs)[:40]:
        buckets, _ = toxicity.word_buckets(*toxicity.tb.buffers(pa.array([t])))
        x = [model.embedding[b].astype(np.float64).sum(0) for b in buckets] or [np.zeros(toxicity.DIM)]
        x = np.array([*x, *[np.zeros(toxicity.DIM)] * toxicity.PAD])
        pooled = []
        for w in toxicity.WIDTHS:
            response = [sum(x[p + k] @ model.filters[w][k] for k in range(w)) for p in range(len(x) - toxicity.PAD)]
            pooled.append(np.maximum(np.max(response, 0) + model.bias[w], 0))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(np.concatenate(pooled) @ model.out + model.offset))), abs=1e-4)


def test_toxicity_learns_from_every_labelled_document(spark):
    """More than 3,000 of a class, and a text above 200,000 bytes: all of them enter training."""
    texts = [(i, f"gut a{i % 40} b{i % 7}" if i % 2 else f"übel a{i % 40} c{i % 7}") for i in range(9000)] + [(9001, "lang " * 60000)]
    documents = spark.createDataFrame([(i, t, "de") for i, t in texts], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts if i % 9], "doc_id long, toxic int")
    parts = toxicity.shards(documents, labels, "toxic", 4).select("shard", "aside", "y", "words").collect()
    learned = [i for i, _ in texts if i % 9 and zlib.crc32(str(i).encode()) % 5]
    assert len(parts) == len(learned) > 6300 and sum(r["y"] for r in parts) == sum(i % 2 for i in learned)
    assert max(len(toxicity._unpacked(r["words"])) for r in parts) == 60000 and len({r["shard"] for r in parts}) == 4


def test_toxicity_of_many_shards(spark):
    base = "/root/testdata/sf0.01"
    documents, labels = util.table(spark, base, "documents"), util.table(spark, base, "labels")
    model = toxicity.train(documents, labels, shard_rows=80)
    got = toxicity.scored(documents.select("doc_id", "text", "lang"), model, "score", "t").join(labels, "doc_id").where(util.held_out(labels["doc_id"])).toPandas()
    assert ((got.score >= 0.5) == got.toxic).mean() >= 0.85


def test_quality_by_plain_densities(docs, spark):
    """Margins against log-densities computed from covariances, without factors."""
    labels = util.table(spark, SF, "labels")
    model = quality.train(docs, labels)
    stats = {r["doc_id"]: np.array(r["_stats"]) for r in quality._frame_statistics(docs, ["doc_id"]).collect()}
    sample = learning.labelled_sample(docs, labels, "quality", quality.PER_CLASS).select("doc_id", "y").collect()
    x, y = np.array([stats[int(r["doc_id"])] for r in sample]), np.array([r["y"] for r in sample])
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    got = {r["doc_id"]: r["score"] for r in quality.query(docs, labels).collect()}
    for i, s in list(stats.items())[:60]:
        density = []
        for c in (0, 1):
            z = (x[y == c] - centre) / scale
            cov, d = np.cov(z.T), z.shape[1]
            weight = min(1.0, model.shrinkage + d / max(d, len(z)) * 0.2)
            cov = (1 - weight) * cov + weight * max(np.trace(cov) / d, 1e-3) * np.eye(d)
            off = (s - centre) / scale - z.mean(0)
            density.append(-0.5 * off @ np.linalg.solve(cov, off) - 0.5 * np.linalg.slogdet(cov)[1])
        margin = density[1] - density[0]
        value = model.slope * np.sign(margin) * np.log1p(abs(margin)) + model.offset
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(value, -30, 30))), abs=1e-6)


@pytest.mark.parametrize("kind", ["int", "string"])
def test_ids_of_any_type(spark, docs, kind):
    own, labels = docs.withColumn("doc_id", docs["doc_id"].cast(kind)), util.table(spark, SF, "labels")
    labels = labels.withColumn("doc_id", labels["doc_id"].cast(kind))
    for module in (toxicity, quality):
        assert rows(module.query(own, labels).selectExpr("cast(doc_id as long)", "score"), "*") == rows(module.query(docs, util.table(spark, SF, "labels")).select("doc_id", "score"), "*")
    bench = util.table(spark, SF, "benchmark")
    assert rows(decontam.query(own, bench).selectExpr("cast(doc_id as long) doc_id", "n_hit"), "*") == rows(decontam.query(docs, bench).select("doc_id", "n_hit"), "*")
    assert substring.query(own).count() == docs.count()


def test_training_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        assert module.query(odd, labels).count() == len(ODD)
    assert set(toxicity.reject_toxic(odd, labels).columns) == set(odd.columns)


def test_labels_of_held_out_rows_are_never_used(spark, docs):
    labels = util.table(spark, SF, "labels")
    flipped = labels.withColumn("toxic", (1 - labels["toxic"])).where(util.held_out(labels["doc_id"])).unionByName(labels.where(~util.held_out(labels["doc_id"])))
    assert learning.class_counts(labels, "toxic") == learning.class_counts(flipped, "toxic")
    assert rows(toxicity.query(docs, labels), "doc_id", "score") == rows(toxicity.query(docs, flipped), "doc_id", "score")


def test_mixing(docs):
    got = mixing.query(docs).toPandas()
    weighted = got.n_tokens * got.weight
    for column in ("source", "lang", "topic"):
        want = mixing.tempered(got.groupby(column).n_tokens.sum().to_dict(), mixing.POWERS[f"_mix_{column}"])
        have = weighted.groupby(got[column]).sum() / weighted.sum()
        assert max(abs(have[k] - v) for k, v in want.items()) < 1e-3
    assert (got.n_tokens * got.probability).sum() == pytest.approx(mixing.KEEP_SHARE * got.n_tokens.sum(), rel=1e-6)


def test_mixing_of_many_cells_agrees(docs):
    few, many = mixing.mixed(docs), mixing.mixed(docs, max_cells=0)
    a, b = dict(rows(few, "doc_id", "_mix_probability")), dict(rows(many, "doc_id", "_mix_probability"))
    assert max(abs(a[k] - b[k]) for k in a) < 1e-9


def brute_mixing(texts, spark):
    """doc_id -> (weight, probability): cells by the rule of the docstring, plain loops for raking, bisection for the rate."""
    import pyarrow as pa

    cells, docs_ = collections.Counter(), []
    for i, t, lang, source in texts:
        words = SPACE.findall(t or "")
        long = [w for w in words if len(w.encode()) >= mixing.TOPIC_BYTES]
        hashes = [int(mixing.tb.split(*mixing.tb.buffers(pa.array([w])), mixing.tb.space_class()).hash[0]) >> 61 for w in long]
        votes = [hashes.count(k) for k in range(mixing.TOPICS)]
        cell = (source, lang, votes.index(max(votes)))
        cells[cell] += len(words)
        docs_.append((i, cell))
    total, weight = sum(cells.values()), dict.fromkeys(cells, 1.0)
    for _ in range(3000):
        for d, power in enumerate((mixing.SOURCE_POWER, mixing.LANG_POWER, mixing.TOPIC_POWER)):
            sums = collections.Counter()
            for c, n in cells.items():
                sums[c[d]] += n
            mass = sum(v**power for v in sums.values())
            have = collections.Counter()
            for c, n in cells.items():
                have[c[d]] += n * weight[c]
            for c in cells:
                weight[c] *= sums[c[d]] ** power / mass * total / have[c[d]]
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(n * min(1, mid * weight[c]) for c, n in cells.items()) < mixing.KEEP_SHARE * total else (low, mid)
    return {i: (weight[c], min(1.0, high * weight[c])) for i, c in docs_}


def test_mixing_by_brute_force(spark, docs):
    full = docs.where("length(text) > 0")
    want = brute_mixing([tuple(r) for r in full.select("doc_id", "text", "lang", "source").collect()], spark)
    got = {r["doc_id"]: (r["weight"], r["probability"]) for r in mixing.query(full).collect()}
    assert got.keys() == want.keys()
    for k, (w, p) in want.items():
        assert got[k] == pytest.approx((w, p), rel=1e-6)


def test_mixing_of_sparse_cells_agrees(spark, monkeypatch):
    """Sources of one language each but for a few words, which need many sweeps; stopped alike after 35."""
    monkeypatch.setattr(mixing, "SWEEPS", 35)
    cells = []
    for i in range(8):
        cells.append((f"s{i}", f"l{i % 2}", "t", 1000 + 300 * i))
        if i % 3 == 0:
            cells.append((f"s{i}", f"l{(i + 1) % 2}", "t", 150))
    df = spark.createDataFrame(cells, "_mix_source string, _mix_lang string, _mix_topic string, tokens long")
    few = {x[:3]: x[3:] for x in mixing._driver_plan(df.collect(), None, 0.8)}
    many = {tuple(r)[:3]: tuple(r)[3:] for r in mixing._table_plan(df, None, 0.8).collect()}
    assert few.keys() == many.keys() and all(many[k] == pytest.approx(few[k], rel=1e-6) for k in few)


def test_mixing_warns_of_targets_not_met(spark):
    cells = [("a", "x", "t", 100), ("b", "y", "t", 100)]  # a source is a language: these shares cannot both hold
    targets = {"_mix_source": {"a": 0.9, "b": 0.1}, "_mix_lang": {"x": 0.2, "y": 0.8}}
    df = spark.createDataFrame(cells, "_mix_source string, _mix_lang string, _mix_topic string, tokens long")
    with pytest.warns(UserWarning, match="off by up to 0.7"):
        mixing._driver_plan(df.collect(), targets, 0.8)


def test_mixing_odd_rows(odd):
    assert mixing.query(odd).count() == len(ODD) and mixing.sample(odd).columns == odd.columns


# --- empty tables, pipeline ---------------------------------------------------------------------------------------


def test_empty_tables(spark, docs):
    none, bench = docs.limit(0), util.table(spark, SF, "benchmark")
    labels = util.table(spark, SF, "labels")
    for df in (neardup.query(none), neardup.keep_one(none), fingerprint.query(none), substring.query(none), decontam.query(none, bench), tokens.query(none, queries.tokenizer_path()), mixing.query(none), toxicity.query(none, labels), quality.query(none, labels), warc.query(util.table(spark, SF, "pages").limit(0))):
        assert df.isEmpty()
    assert decontam.query(docs, bench.limit(0)).where("n_hit > 0").isEmpty()


def test_pipeline_stages(spark, odd):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "mixing", "token_output"]
    documents, kept = util.table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = util.materialize(stage(spark, documents, SF), "test-stage")
        assert out.columns == documents.columns
        documents, kept[name] = out, {r[0] for r in out.select("doc_id").collect()}
    final = corpus_pipeline.STAGES[-1][1](spark, documents, SF)
    assert {r[0] for r in final.select("doc_id").collect()} == kept["mixing"]
    assert corpus_pipeline.run(spark, SF).count() == len(kept["mixing"])


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages_of_odd_and_empty_tables(spark, odd, empty):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        out = util.materialize(stage(spark, odd.limit(0) if empty else odd, SF), f"test-odd-{name}")
        assert name == "token_output" or out.columns == odd.columns
        assert out.isEmpty() if empty else out.count() > 0


def test_pipeline_by_brute_force(spark):
    """Each stage recomputed without its operator: rejected, duplicate, contaminated and undrawn rows; then tokens."""
    import corpus_pipeline
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    documents, labels = util.table(spark, SF, "documents"), util.table(spark, SF, "labels")
    verdict = {r["doc_id"]: r["score"] >= r["language_threshold"] for r in toxicity.query(documents, labels).collect()}
    docs_ = sorted((r["doc_id"], r["text"], r["lang"], r["source"]) for r in documents.collect() if not verdict[r["doc_id"]])
    sets, parent = [shingles5(d[1]) for d in docs_], list(range(len(docs_)))
    for i in range(len(docs_)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = i, j
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                parent[max(a, b)] = min(a, b)
    docs_ = [d for i, d in enumerate(docs_) if parent[i] == i]
    bad = contaminated([d[:2] for d in docs_], [tuple(r) for r in util.table(spark, SF, "benchmark").select("item_id", "text").collect()], 13)
    bad = {r[0] for r in bad if r[5]}
    docs_ = [d for d in docs_ if d[0] not in bad]
    probability = {i: p for i, (_, p) in brute_mixing([d for d in docs_ if SPACE.findall(d[1] or "")], spark).items()}
    uniform = {r["id"]: r["u"] for r in spark.createDataFrame([(d[0],) for d in docs_], "id long").select("id", (F.shiftrightunsigned(F.xxhash64("id", F.lit(8)), 11) / F.lit(float(1 << 53))).alias("u")).collect()}
    docs_ = [d for d in docs_ if d[0] not in probability or uniform[d[0]] < probability[d[0]]]
    encode, want, start = Tokenizer.from_file(queries.tokenizer_path()).encode, [], 0
    for i, t, *_ in docs_:
        ids = np.array([*encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(r for r in got if r[0] in probability) == sorted(w for w in want if w[0] in probability) if len(got) == len(want) else False
