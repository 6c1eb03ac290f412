"""Spelling variants, the conversation trie and archives against plain versions, and on odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quoteloom.llm import spelling, trie, warc
from quoteloom.llm.common import table
from quoteloom.llm.queries import misspelt
from quoteloom.llm.ranges import along

WORDS = "word string, n long"
TURNS = "conv_id long, turn long, role string, text string, depth string"
PAGES = "page_id long, url string, html string, row string, digest int"


def near(a, b):
    """One character inserted, deleted or replaced, by trying all."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_groups(n, ratio=10):
    nears = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in nears.items() if v}
    form = {w: v for w, v in best.items() if n[v] >= ratio * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (n[w], len(nears[w]), form.get(w), n.get(form.get(w)), root(w)) for w in n}


def groups(spark, n, **how):
    found = spelling.variant_groups(spark.createDataFrame(list(n.items()), WORDS), **how).collect()
    assert len(found) == len(n)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in found}


@pytest.mark.parametrize("size", [1 << 20, 40])
def test_variants_against_all_pairs(spark, size):
    rng = random.Random(3)
    n = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))): 10 ** rng.randint(0, 4) for _ in range(150)}
    n |= {"a" * k: 5 * k for k in range(1, 8)}  # runs of one character, and words that begin others
    assert groups(spark, n, size=size) == brute_groups(n)


def test_variants_follow_forms_to_the_last(spark):
    n = {"aaaaaaa": 1, "aaaaaab": 10, "aaaaabb": 100, "aaaabbb": 1000, "aaabbbb": 10_000, "zzzzzzz": 3}
    got = groups(spark, n)
    assert got == brute_groups(n)
    assert got["aaaaaaa"][2:] == ("aaaaaab", 10, "aaabbbb") and got["zzzzzzz"] == (3, 0, None, None, "zzzzzzz")


def test_variants_of_long_words(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abc") for _ in range(30_000))
    n = {long: 50, long[:15_000] + long[15_001:]: 2, long + "a": 3, long[:-1] + "é": 4, "short": 1}
    got = groups(spark, n, size=40_000)  # the long ones lie in different ranges
    assert got == brute_groups(n)


def test_words_are_counted(spark):
    rows = [(1, "Grüße Grüße STRASSE strasse straße, naïveté x_naïveté9 Ünlïmïted"), (2, "strasse"), (2, "strasse"), (None, "nothing Nothing"), (3, None), (4, ""), (5, "ABCDEFG" * 5000)]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    got = {r.word: r.n for r in spelling.word_counts(docs).collect()}
    assert got == {"strasse": 4, "naïveté": 2, "nothing": 2}
    assert {r.word for r in spelling.word_counts(docs, often=1).collect()} - set(got) == {"Ünlïmïted".replace("U", "u"), "abcdefg" * 5000}
    none = spelling.variant_groups(spelling.word_counts(docs.limit(0)))
    assert none.count() == 0 and none.columns == ["word", "n", "n_near", "form", "form_n", "root"]


def test_words_lose_a_letter_by_their_hash():
    for doc_id in range(200):
        run = "étrangère"
        h = zlib.crc32(f"{doc_id}:{run}".encode())
        want = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
        assert misspelt(doc_id, run.encode()).decode() == want
    assert misspelt(None, b"abcdefgh") in (b"abcdefgh", *(b"abcdefgh"[:k] + b"abcdefgh"[k + 1 :] for k in range(8)))


def test_running_values_of_a_key_over_many_ranges(spark):
    rng = random.Random(5)
    rows = [(1, k, rng.randint(0, 9), rng.getrandbits(60)) for k in range(3000)] + [(rng.randint(-3, 5), 5000 + k, 1, k) for k in range(500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = along(spark.createDataFrame(rows, "k long, o long, v long, x long"), "k", ["o"], ["o"], ["v"], ["x"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, state = set(), defaultdict(lambda: (0, 0, 0))
    for k, o, v, x in sorted(rows):
        at, s, z = state[k]
        state[k] = (at + 1, s + v, z ^ x)
        want.add((k, o, *state[k]))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def brute_trie(rows, block=None):
    said = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            said[c].append(((turn is not None, turn or 0), role or "", text or ""))
    said = {c: [(r, t) for _, r, t in sorted(v)] for c, v in said.items()}
    if block:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in said}
        said = {c: said.get(c - (abs(c) % block) * (1 if c > 0 else -1), [])[: h[c]] + v[h[c] :] for c, v in said.items()}
    nodes, ends = defaultdict(list), defaultdict(list)
    for c, v in sorted(said.items()):
        ends[tuple(v)].append(c)
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    out = []
    for p, m in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in under if q)
        sha = hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
        out.append((m[0], len(p), nodes[p[:-1]][0] if p else None, len(m), kids[p], sum(q not in kids for q in under), saved, sha))
    return sorted(out, key=str)


def nodes_of(spark, rows, **how):
    got = trie.prefix_trie(spark.createDataFrame([(*r, "x") for r in rows], TURNS), **how)
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("block", [None, 100, 7])
def test_trie_against_all_prefixes(spark, block):
    rng = random.Random(6)
    rows = []
    for c in [*range(0, 30), 100, 101, 205, 206, 999, -1, -105]:
        rows += [(c, t, rng.choice(["user", None]), rng.choice(["a", "bb", "", None])) for t in range(rng.randint(1, 5))]
    rows += [(50, None, "user", "a"), (50, 2, "user", "later"), (50, 2, "user", "earlier"), (50, 2, "user", "earlier"), (None, 0, "user", "lost")]
    rng.shuffle(rows)
    assert nodes_of(spark, rows, block=block, fan=2) == brute_trie(rows, block)


def test_trie_of_many_ends_and_a_long_path(spark):
    rows = [(c, 0, "user", "hello") for c in range(5000)]  # more ends at a node than a piece holds
    rows += [(7000, t, "user", f"{t}") for t in range(1500)] + [(7001, t, "user", f"{t}") for t in range(700)]
    got = nodes_of(spark, rows)
    hello = hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest()
    assert (0, 1, 0, 5000, 0, 1, 4999 * 5, hello) in got and len(got) == 1502
    shared = sum(len(f"{t}") for t in range(700))
    assert (0, 0, None, 5002, 2, 2, 4999 * 5 + shared, trie.NOTHING) in got
    assert [r[3:7] for r in got if r[:2] == (7000, 700)] == [(2, 1, 1, 3)] and [r[3:7] for r in got if r[:2] == (7000, 1500)] == [(1, 0, 1, 0)]


def test_trie_of_nothing(spark):
    assert nodes_of(spark, []) == [] and nodes_of(spark, [], block=100) == []


def stored(spark, rows, tmp_path, **how):
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES).repartition(3, "page_id")
    manifest = warc.write(pages, str(tmp_path / "out"), **how)
    return manifest, warc.read(manifest).collect()


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(7)
    html = ["<html>" + " ".join(rng.choice(["seite", "größe", "<p>", "\r\n\r\n", "0"]) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    rows = [(k, f"http://a.example/{k}?q=ä b\r\nX: y%20", html[k % 60]) for k in range(1, 150)]
    rows += [(200, None, None), (201, "u", ""), (202, "u", ""), (None, "u", html[5]), (203, "u", "x" * 2_000_000), (150, "u", html[5]), (150, "u", html[5])]
    for sample, most in ((1 << 22, 1 << 30), (2000, 3000)):
        manifest, got = stored(spark, rows, tmp_path / str(most), sample=sample, most=most)
        assert sum(r.records for r in manifest.collect()) == len(rows) == len(got)
        firsts, places = {}, {(r.page_id, r.url): r for r in got}
        for page_id, _, text in rows:
            if len((text or "").encode()) >= 100:
                firsts[text] = min(firsts.get(text, 10**9), 10**9 if page_id is None else page_id)
        ids = {r.record_id: r for r in got}
        assert len(ids) == len(rows)
        for page_id, url, text in rows:
            r, raw = places[page_id, url], (text or "").encode()
            assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
            if text in firsts and page_id != firsts[text]:
                assert (r.record_type, r.refers_to, r.payload) == ("revisit", firsts[text], None)
                first = ids[r.refers_to_record]
                assert (first.page_id, first.record_type, first.payload) == (firsts[text], "response", raw)
            else:
                assert (r.record_type, r.refers_to, r.payload) == ("response", None, raw)


def test_one_response_among_equal_rows(spark, tmp_path):
    _, got = stored(spark, [(1, "u", "y" * 100)] * 5 + [(2, "u", "z" * 99)] * 2, tmp_path)
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == {(1, "response", None): 1, (1, "revisit", 1): 4, (2, "response", None): 2}


def test_an_archive_is_a_dictionary_and_frames(spark, tmp_path):
    import zstandard

    rng = random.Random(8)
    rows = [(k, "http://x.example/", " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 99)) for _ in range(80))) for k in range(400)]
    manifest, _ = stored(spark, rows, tmp_path)
    for line in manifest.collect():
        raw = open(line.path, "rb").read()
        size = int.from_bytes(raw[4:8], "little")
        assert raw[:4] == warc.SKIPPABLE and size == line.dictionary_bytes and raw[8:12] == warc.TRAINED
        first = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size])).decompressobj().decompress(raw[8 + size :])
        assert first.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and len(raw) == line.bytes


def test_damaged_archives_fail(spark, tmp_path):
    one = warc.record({"page_id": 1, "url": "u", "row": 0, "html": "abc", "digest": "0" * 64, "first": None})
    with pytest.raises(ValueError, match="digest"):
        warc.parsed(one)
    with pytest.raises(ValueError, match="whole record"):
        warc.parsed(one[:-3])


def test_no_archives(spark, tmp_path):
    manifest, got = stored(spark, [], tmp_path)
    assert manifest.count() == 0 and got == []


def test_records_of_the_tables(spark):
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    got = warc.read(warc.write(pages)).select("page_id", F.decode("payload", "UTF-8").alias("html"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pages.select("page_id", "html").collect()))
