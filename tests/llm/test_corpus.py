"""Corpus operators against brute force on small fixtures, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash

from pyspark.sql import functions as F

import corpus_pipeline
from meridian.llm import common, fmindex, linededup, packing, pieces, pitmanyor, queries, rules, simhash, suffixdedup, tokencounts, warc
from same import duck_rows, spark_rows

DOCS = "doc_id long, text string, rep string, fp string, grp int, batch int, gone string"


def corpus(spark, n=40, seed=1):
    """Texts with copies, near copies, shared passages, nulls, empties, one long text, a repeated row; columns that clash with the operators' own."""
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma,", "délta", "eps", "zeta.", "eta", "Theta", "iota", "kappa", "日本", "#tag"]
    text = lambda k: " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(k))
    lines = lambda: "\n".join(text(12) for _ in range(6))
    shared = text(30)
    out = [(i, lines()) for i in range(n)]
    out += [(n, out[3][1]), (n + 1, out[3][1]), (n + 2, out[4][1].replace("eta", "ETA", 1)), (n + 3, shared + "\n" + lines()), (n + 4, lines() + " " + shared)]
    out += [(n + 5, None), (n + 6, ""), (n + 7, " \n\t "), (n + 8, "one two"), (n + 9, text(4000)), (n + 10, out[5][1]), (n + 10, out[5][1]), (n + 11, "x\n\nx\n\nx\n\nx"), (None, out[6][1]), (None, None)]
    rows = [(i, t, "r", "f", 1, 2, "g") for i, t in out]
    return out, spark.createDataFrame(rows, DOCS).repartition(3)


def low(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def split(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", t) if w]


# --- 1 ---


def brute_fingerprint(t):
    w = split(low(t))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash(spark):
    docs, df = corpus(spark)
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(df).collect()]
    known = [d for d in docs if d[0] is not None]
    fps = [brute_fingerprint(t) for _, t in known]
    comp = {known[i][0]: known[r][0] for i, r in enumerate(brute_components(fps, 3))}
    assert len(got) == len(docs)
    assert {g[0]: g[1] for g in got if g[0] is not None} == {d: f for (d, _), f in zip(known, fps, strict=True)}
    assert {g[0]: g[2] for g in got if g[0] is not None} == comp
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [3, 20_000])
def test_links_lose_nothing(spark, hot):
    rng = random.Random(5)
    centre = [rng.getrandbits(64) for _ in range(6)]
    fps = {c for c in centre}
    for c in centre:
        for _ in range(30):
            x = c
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    found = {r.node: r.root for r in common.components(simhash.links(rows, 3, hot)).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == brute_components(fps, 3)


def test_crowded_buckets_are_dealt_again(spark):
    rows = spark.range(1000).select(F.col("id").alias("fp"), F.col("id").alias("rep"), F.lit(1).alias("n"), F.when(F.col("id") < 900, 1).otherwise(F.col("id")).alias("bucket"))
    dealt = simhash._dealt(rows, 100, 1000).collect()
    by = defaultdict(set)
    for r in dealt:
        by[r.bucket].add(r.rep)
    assert max(map(len, by.values())) <= 280
    met = {(a, b) for own in by.values() for a in own for b in own if a < b}
    assert met == {(a, b) for a in range(900) for b in range(a + 1, 900)}


def test_bit_sliced_distances():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 200, dtype=np.uint64)
    x[50:100] = x[:50] ^ np.uint64(0b1011)
    for radius in (0, 1, 2, 3, 5):
        near = simhash.within(x[:70], simhash.planes(x), radius)
        bits = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, :200]
        assert (bits == (np.bitwise_count(x[:70, None] ^ x[None, :]) <= radius)).all()
    far = np.array([2**64 - 1], np.uint64)
    assert simhash.within(np.zeros(1, np.uint64), simhash.planes(np.repeat(far, 64)), 3) is None


def test_keep_one(spark):
    docs, df = corpus(spark)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[3] == 1 and 40 not in ids and ids[5] == 1 and 50 not in ids and ids[None] == 2


def test_similar_documents_are_found(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    docs, alike = [], {}
    for i in range(60):
        base = [word() for _ in range(400)]
        docs.append((10 * i, " ".join(base)))
        for k in (1, 2):  # four changed words: a similarity of about 0.9
            copy = list(base)
            for p in rng.sample(range(400), 4):
                copy[p] = word()
            docs.append((10 * i + k, " ".join(copy)))
            alike[10 * i + k] = 10 * i
        half = base[:200] + [word() for _ in range(200)]
        docs.append((10 * i + 5, " ".join(half)))  # a similarity of a third
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for hot in (20_000, 2):
        got = {r.doc_id: r.component_id for r in simhash.similar_groups(df, hot=hot).collect()}
        assert sum(got[k] == v for k, v in alike.items()) >= 0.97 * len(alike)
        assert all(got[10 * i] == 10 * i and got[10 * i + 5] == 10 * i + 5 for i in range(60))


@pytest.mark.parametrize("hot", [2, 64])
def test_similar_groups_equal_brute_force(spark, hot):
    rng = random.Random(11)
    words = lambda k: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(k)]
    line, texts = words(8), []
    for short, long in ((40, 52), (40, 49), (38, 44)):  # 36 of 48, 36 of 45 and 34 of 40 shingles: 0.75, 0.8 and 0.85
        for _ in range(30):
            base = words(long)
            texts += [base[:short], base]
    for _ in range(6):  # groups around one text, whose members are alike in 0.6 to 0.95, and a line that many share
        base = words(80)
        for k in range(12):
            copy = list(base)
            for p in rng.sample(range(80), k % 5):
                copy[p] = words(1)[0]
            texts.append(copy + (line if k % 2 else []))
    texts += [words(30) + line for _ in range(20)] + [[], [], ["one", "two"], ["One", "TWO"], texts[3], texts[4]]
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} if t else set() for t in ([w.lower() for w in t] for t in texts)]
    root = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and (x == sets[j] or len(x & sets[j]) >= 0.8 * len(x | sets[j])):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(df, hot=hot).collect()} == dict(enumerate(root))


# --- 2 ---


def test_token_counts_by_line(spark):
    docs, df = corpus(spark)
    got = tokencounts.count_sections(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter({d: len(tok.encode(t, add_special_tokens=False).ids) for d, t in docs if t})
    want[50] *= 2  # the repeated row
    have = Counter()
    for r in got:
        have[r.doc_id] += r.n_tokens
    assert {k: v for k, v in have.items() if k is not None} == {k: v for k, v in want.items() if k is not None}
    spans = sorted((r.char_start, r.char_end) for r in got if r.doc_id == 0)
    text = dict(docs[:40])[0]
    assert [text[a:z] for a, z in spans] == text.splitlines(keepends=True)


def test_token_counts_equal_brute_force(spark):
    """Each token's bytes are dealt to lines one by one; the tokenizer's own decoding says which bytes a token has."""
    docs, df = corpus(spark)
    odd = [(100, b"ab\xff\xffcd\nx"), (101, b"\n\n\n"), (102, ("a" + " " * 30_000 + "b \n\n c" + "\n" * 20_000).encode()), (103, "日\n本 \n".encode())]
    more = spark.createDataFrame([(d, bytearray(t)) for d, t in odd], "doc_id long, text binary")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoding, _ = tokencounts._encoding(path, public_tokenizers.PATTERN)
    both = df.selectExpr("doc_id", "CAST(text AS binary) AS text").unionByName(more)
    got = Counter((r.doc_id, r.section, r.char_start, r.char_end, r.n_tokens, r.n_crossing) for r in tokencounts.count_sections(both, path, public_tokenizers.PATTERN).collect())
    want = Counter()
    for d, t in docs + [(d, t.decode(errors="replace")) for d, t in odd]:
        if not t:
            continue
        lines = t.splitlines(keepends=True) if "\n" in t and not re.search("[\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]", t) else [t] if "\n" not in t else re.findall("[^\n]*\n|[^\n]+", t)
        owner = [i for i, x in enumerate(lines) for _ in x.encode()]
        tokens, crossing, at = Counter(), Counter(), 0
        for piece in encoding.decode_tokens_bytes(encoding.encode_ordinary(t)):
            over = Counter(owner[at : at + len(piece)])
            best = min(over, key=lambda i: (-over[i], i))
            tokens[best] += 1
            crossing[best] += len(over) > 1
            at += len(piece)
        start = 0
        for i, x in enumerate(lines):
            want[d, i, start, start + len(x), tokens[i], crossing[i]] += 1
            start += len(x)
    assert got == want


def test_long_blank_runs_do_not_stop_the_tokenizer(spark):
    df = spark.createDataFrame([(1, "x" + " " * 2_000_000 + "y"), (2, "\n" * 1_500_000)], "doc_id long, text string")
    found = tokencounts.count_sections(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).groupBy("doc_id").sum("n_tokens").collect()
    assert {r[0]: r[1] for r in found}[1] == 2_000_001 and {r[0]: r[1] for r in found}[2] > 0


def test_crossing_tokens_follow_the_rule():
    stops, ends = np.array([2, 7, 9]), np.array([3, 8, 9])  # the token [2, 7) has one byte in the first section and four in the second
    assert tokencounts.allocate(stops, ends)[0].tolist() == [0, 1, 1] and tokencounts.allocate(stops, ends, "first")[0].tolist() == [0, 0, 1]
    assert tokencounts.allocate(stops, ends, "last")[0].tolist() == [0, 1, 2] and tokencounts.allocate(stops, ends)[1].tolist() == [False, True, True]
    assert tokencounts.allocate(np.array([4]), np.array([2, 4]))[0].tolist() == [0]  # of equals the first


# --- 3 ---


def brute_lines(docs, width=3):
    first, gone = {}, defaultdict(set)
    keyed = sorted({(d, t) for d, t in docs if d is not None and t is not None})
    for d, t in keyed:
        ls = t.split("\n")
        for p in range(len(ls) - width + 1):
            win = tuple(ls[p : p + width])
            if any(x.strip(" \t\r") for x in win) and first.setdefault(win, (d, p)) != (d, p):
                gone[d].update(range(p, p + width))
    return gone


def test_line_dedup(spark):
    docs, df = corpus(spark)
    gone = brute_lines(docs)
    out = linededup.dedup_lines(df)
    assert set(df.columns) <= set(out.columns)
    for r in out.collect():
        t = next(t for d, t in docs if d == r.doc_id) if r.doc_id is not None else r.text
        if t is None:
            assert r.text is None and r.n_lines == 0
        else:
            ls = t.split("\n")
            assert r.text == ("\n".join(x for i, x in enumerate(ls) if i not in gone[r.doc_id]) if gone.get(r.doc_id) else t)
            assert (r.n_lines, r.n_removed) == (len(ls), len(gone.get(r.doc_id, ())))
    assert linededup.dedup_lines(df.limit(0)).count() == 0
    ids = {r.doc_id for r in linededup.drop_repeats(df).collect()}
    assert {3, 45, 46} <= ids and not ids & {40, 41}


# --- 4 ---


def test_warc_round_trip(spark):
    pages = [(5, "http://www.b.com/x?q=1", "same"), (3, "http://a.com/", "same"), (9, "http://b.com/x?q=1", "Ünï"), (1, None, None), (2, "bad url\r\n", ""), (7, "http://a.com/", "same"), (7, "http://a.com/", "same"), (None, "http://n.com/", "same"), (None, "http://n.com/", "only")]
    df = spark.createDataFrame([(*p, 1, "k") for p in pages], "page_id long, url string, html string, ts int, urlkey string").repartition(3)
    index = warc.archive(df)
    got = warc.read_archives(index).collect()
    assert len(got) == len(pages)
    by = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert by == {(3, "response", None), (5, "revisit", 3), (7, "revisit", 3), (9, "response", None), (1, "response", None), (2, "revisit", 1), (None, "revisit", 3), (None, "response", None)}
    for r in got:
        html = {p: h for p, _, h in pages if p is not None}.get(r.page_id, r.payload.decode() if r.payload else "same") or ""
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == warc.digest(html.encode())
        assert r.payload == (html.encode() if r.record_type == "response" else None)
    keys = [(r.urlkey, r.ts, -1 if r.page_id is None else r.page_id) for r in index.collect()]
    assert keys == sorted(keys)
    assert {r.record_type for r in warc.read_archives(warc.archive(df, least=5)).collect()} == {"response"}
    assert warc.archive(df.limit(0)).count() == 0


def test_ids_with_several_payloads(spark):
    """Every row is one record, told apart by its payload, and every payload can be read."""
    long = "long " * 400_000
    pages = [(1, "A"), (2, "B"), (5, "A"), (5, "B"), (7, "B"), (7, "unique"), (8, long), (9, long), (9, None)]
    df = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in pages], "page_id long, url string, html string").repartition(4)
    got = warc.read_archives(warc.archive(df)).collect()
    first = {h: min(i for i, x in pages if x == h) for _, h in pages}
    want = [(i, warc.digest((h or "").encode()), *(("response", None) if first[h] == i else ("revisit", first[h]))) for i, h in pages]
    assert sorted(map(str, ((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(str, want))
    assert {r.payload.decode() for r in got if r.record_type == "response"} == {"A", "B", "unique", long, ""}


def test_loser_tree():
    rng = random.Random(2)
    for k in (0, 1, 2, 5, 8):
        runs = [sorted((rng.randrange(20), i, j) for j in range(rng.randrange(6))) for i in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_warc_records_are_whole():
    rec = warc.record(4, "http://x/ y", b"a\r\n\r\nb", None, False)
    head, http, payload = warc.parse(rec)
    assert payload == b"a\r\n\r\nb" and head["WARC-Target-URI"] == "http://x/%20y" and rec.endswith(b"\r\n\r\n")
    with pytest.raises(ValueError, match="length"):
        warc.parse(rec[:-3])


# --- 5 ---


def brute_hits(text, items, width=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    hit, found = set(), set()
    for i, t in items:
        x = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        n = min(width, len(x))
        for s in range(len(x) - n + 1 if x else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == x[s : s + n]:
                    hit.update(range(p, p + n))
                    found.add(i)
    return len(w), hit, found


@pytest.mark.parametrize("block", [1 << 20, 120])
def test_decontamination(spark, block):
    docs, df = corpus(spark, 12)
    words = docs[13][1].split()
    items = [(1, " ".join(words[3:17])), (2, docs[2][1].split()[4].upper()), (3, None), (4, "..."), (5, "nothing like it at all here"), (6, " ".join(words[5:9])), (6, " ".join(words[20:34])), (10, " ".join(words[3:17]))]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, n_words string")
    got = fmindex.digest(fmindex.find(df, bench, block=block)).collect()
    assert len(got) == len(docs)
    for r in got:
        if r.doc_id is None:
            continue
        n, hit, found = brute_hits(next(t for d, t in docs if d == r.doc_id), items)
        listed = ",".join(sorted(map(str, found)))
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit))
    clean = fmindex.decontaminate(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in got if not r.contaminated}
    cut = {r.doc_id: r.text for r in fmindex.decontaminate(df, bench, cut_spans=True).collect()}
    assert len(split(cut[12])) < len(split(docs[12][1])) and cut[17] is None
    assert fmindex.find(df.limit(0), bench).count() == 0 and fmindex.digest(fmindex.find(df, bench.limit(0))).filter("contaminated").count() == 0


def test_fm_index_finds_all():
    rng = np.random.default_rng(3)
    seq = rng.integers(1, 4, 300)
    q = rng.integers(1, 4, (40, 5))
    n = rng.integers(1, 6, 40)
    index = fmindex.FMIndex(seq, 4)
    lo, hi = index.search(q, n)
    for row, k, a, z in zip(q, n, lo, hi, strict=True):
        want = [p for p in range(len(seq) - k + 1) if (seq[p : p + k] == row[:k]).all()]
        assert sorted(index.locate(np.arange(a, max(a, z)))) == want


# --- 6 ---


@pytest.mark.parametrize("top", [1, 2, 300, 60_000, 2**33, 2**64 - 1])
def test_simple8b_round_trip(top):
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, packing.BLOCK, packing.BLOCK + 1, 5000):
        x = rng.integers(0, top, n, dtype=np.uint64, endpoint=False)
        x[n // 3 : n // 2] = 0
        words, n_words, n_escapes = packing.pack(x)
        sizes = np.full(-(-n // packing.BLOCK), packing.BLOCK)
        if n:
            sizes[-1] = n - packing.BLOCK * (len(sizes) - 1)
        assert (packing.unpack(words, n_words, n_escapes, sizes) == x).all() and len(words) == n_words.sum() + n_escapes.sum()


def test_token_files(spark):
    docs, df = corpus(spark)
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = packing.read_tokens(packing.token_files(df, path)).orderBy("start").collect()
    assert len(got) == len(docs) and [r.doc_id for r in got] == sorted((d for d, _ in docs), key=lambda d: (d is not None, d or 0))
    at = 0
    for r in got:
        if r.doc_id is not None:
            ids = [*tok.encode(next(t for d, t in docs if d == r.doc_id) or "", add_special_tokens=False).ids, 1]
            assert r.ids == ids and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    assert packing.read_tokens(packing.token_files(df.limit(0), path)).count() == 0


def test_word_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, enc = Tokenizer.from_file(path), packing.WordEncoder(path, parts=4, units=6)
    odd = ["", "áb c' d'll can't", "<|endoftext|> x<|STARTOFTEXT|>y", "  İstanbul ΣΑΣ\x1c\x85", "ﬁ 12 ½ 한국어!?", "a,b. c...\n\n(d)", "Été, ÉTÉ. été!!"] * 2
    ids, n = enc.encode([t.encode() for t in odd])
    assert [ids[z - k : z].tolist() for z, k in zip(np.cumsum(n), n, strict=True)] == [tok.encode(t, add_special_tokens=False).ids for t in odd]


# --- 7 ---


def brute_spans(docs, width):
    first, gone = {}, {}
    for d, t in sorted(((d, (t or "").encode()) for d, t in docs if d is not None), key=lambda x: x[0]):
        cover = bytearray(len(t))
        for p in range(len(t) - width + 1):
            if first.setdefault(t[p : p + width], d) < d:
                cover[p : p + width] = b"\1" * width
        gone[d] = cover
    return gone


@pytest.mark.parametrize("width", [50, 24])
def test_substring_dedup(spark, width):
    docs, df = corpus(spark)
    gone = brute_spans(docs, width)
    got = suffixdedup.dedup_substrings(df, width).collect()
    assert len(got) == len(docs)
    for r in got:
        t = (next(t for d, t in docs if d == r.doc_id) or "").encode() if r.doc_id is not None else r.kept
        cover = gone.get(r.doc_id, bytearray(len(t)))
        kept = bytes(c for c, g in zip(t, cover, strict=True) if not g)
        runs = sum(1 for k in range(len(t)) if cover[k] and (k == 0 or not cover[k - 1]))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept, r.kept_sha256) == (len(t), len(t) - len(kept), runs, kept, hashlib.sha256(kept).hexdigest())
    assert sum(r.n_removed for r in got) > 0 and suffixdedup.dedup_substrings(df.limit(0)).count() == 0


@pytest.mark.parametrize("width", [16, 24, 50])
def test_previous_factors_equal_brute_force(width):
    rng = np.random.default_rng(width)
    for _ in range(15):
        data = rng.integers(97, 99, int(rng.integers(width, 300))).astype(np.uint8)
        places = np.flatnonzero(rng.random(len(data) - width + 1) < 0.4)
        doc, text = rng.integers(0, 6, len(places)), data.tobytes()
        shared = lambda i, j: next((k for k in range(width) if text[i + k] != text[j + k]), width)  # noqa: B023, E731
        want = [max([shared(p, q) for q, e in zip(places, doc, strict=True) if e < d], default=0) for p, d in zip(places, doc, strict=True)]
        assert suffixdedup.previous_factors(data, places, doc, width).tolist() == want


def test_a_passage_of_every_document(spark):
    """Hot strings meet over several levels: two texts a batch, groups of two batches at a time."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage, blanks = " ".join(word() for _ in range(40)), " " * 300
    docs = [(i, " ".join(word() for _ in range(rng.randrange(30))) + passage + (blanks if i % 3 else "-=" * 90) + " ".join(word() for _ in range(30))) for i in range(60)]
    docs += [(60, passage[:49]), (61, passage[5:60]), (62, None), (63, passage), (63, passage), (7, "x" + passage)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    gone = {d: [] for d, _ in docs}
    known = {}
    for d, t in docs:
        raw = (t or "").encode()
        for p in range(len(raw) - 49):
            known[raw[p : p + 50]] = min(d, known.get(raw[p : p + 50], d))
    for d, t in docs:
        raw, cover = (t or "").encode(), bytearray(len((t or "").encode()))
        for p in range(len(raw) - 49):
            if known[raw[p : p + 50]] < d:
                cover[p : p + 50] = b"\1" * 50
        gone[d].append(bytes(c for c, g in zip(raw, cover, strict=True) if not g))
    for fan, batch in ((2, 800), (1000, 800)):
        got = {}
        for r in suffixdedup.dedup_substrings(df, fan=fan, batch=batch).collect():
            got.setdefault(r.doc_id, []).append(bytes(r.kept))
        assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in gone.items()}


# --- 8 ---


@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattice(public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_decode_losslessly(spark, lattice):
    docs, df = corpus(spark)
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = pieces.encode(df, path).collect()
    assert len(got) == len(docs) and all(r.lossless for r in got)
    again = {r.doc_id: r.ids for r in pieces.encode(df.repartition(1), path).collect()}
    assert all(again[r.doc_id] == r.ids for r in got if r.doc_id is not None)
    other = {r.doc_id: r.ids for r in pieces.encode(df, path, seed=1).collect()}
    assert any(other[r.doc_id] != r.ids for r in got)
    odd = ["", "  two  spaces ", "▁lit▁", "日本語 \U0001f600 x", "\n\n a\n", " ", "\x00\x85", "x" * 300]
    ids, n = lattice.sample([t.encode() for t in odd], np.arange(len(odd)))
    assert [lattice.decode(ids[z - k : z]).decode() for z, k in zip(np.cumsum(n), n, strict=True)] == odd
    assert pieces.encode(df.limit(0), path).count() == 0


def test_decoding_a_table(spark):
    docs, df = corpus(spark)
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = pieces.decode(pieces.encode(df, path).withColumn("decoded", F.lit(1)), path)
    assert Counter((r.doc_id, bytes(r.decoded)) for r in rows.collect()) == Counter((d, (t or "").encode()) for d, t in docs)
    assert pieces.decode(spark.createDataFrame([(1, None), (2, [])], "id long, ids array<int>"), path).orderBy("id").collect()[0].decoded is None


def test_samples_follow_the_lattice(lattice):
    def ways(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in lattice.ids:
                for rest in ways(s[k:]):
                    yield (s[:k], *rest)

    weight = {s: math.prod(lattice.weight[p] for p in s) for s in ways("▁then")}
    total, names = sum(weight.values()), {i: p for p, i in lattice.ids.items()}
    ids, n = lattice.sample([b"then"] * 20_000, np.arange(20_000))
    seen = Counter(tuple(names[i] for i in ids[z - k : z]) for z, k in zip(np.cumsum(n), n, strict=True))
    assert set(seen) <= set(weight) and all(abs(seen[s] / 20_000 - w / total) < 0.02 for s, w in weight.items())


def test_long_units_follow_the_lattice(lattice):
    rng = random.Random(3)
    unit = "▁" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1000))
    assert all(c in lattice.ids for c in unit)
    forward = [0.0]
    for z in range(1, len(unit) + 1):  # in logarithms
        logs = [forward[a] + math.log(lattice.weight[p]) for a in range(max(0, z - lattice.longest), z) if (p := unit[a:z]) in lattice.ids]
        forward.append(max(logs) + math.log(sum(math.exp(x - max(logs)) for x in logs)))
    share, prev, piece, made = lattice._filter(unit)
    names = {i: p for p, i in lattice.ids.items()}
    assert made == len(unit) and forward[-1] < math.log(1e-300)
    below, node = 0.0, -1
    for s, a, i in zip(share, prev, piece, strict=True):  # node z - 1 ends at place z, and -1 is the start
        z = math.ceil(s) - 1
        below, node = (below if z == node else 0.0), z
        want = math.exp(forward[a + 1] + math.log(lattice.weight[names[i]]) - forward[z + 1])
        assert a + 1 + len(names[i]) == z + 1 and abs(s - z - below - want) < 1e-9
        below = s - z


# --- 9 ---


def brute_counts(t):
    w = split(t or "")
    win = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {k for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for x in (t or "").split("\n"):
        if split(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(rep)


def test_rule_statistics(spark):
    docs, df = corpus(spark)
    more = [*docs, (90, "a b c a b c a b\na\na"), (91, "x x x x"), (92, "a b")]
    df = spark.createDataFrame([(d, t, 1) for d, t in more], "doc_id long, text string, n_words int")
    for r in rules.statistics(df).collect():
        if r.doc_id is not None:
            assert tuple(r[c] for c in rules.COUNTS) == brute_counts(next(t for d, t in more if d == r.doc_id))


def test_rules_are_learned_and_hold_out(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        rows.append((i, " ".join(word() + ("#$" if bad and rng.random() < 0.7 else "") for _ in range(60)), 0 if bad else 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = df.filter("doc_id < 300").select("doc_id", "quality").unionAll(spark.createDataFrame([(None, 1), (5, None), (9999, 0)], "doc_id long, quality int"))
    got = rules.judge(df.select("doc_id", "text"), labels).join(df.select("doc_id", "quality"), "doc_id").filter("doc_id >= 300").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) / len(got) > 0.97
    learned = rules.fit(rules.statistics(df), labels)
    assert learned.rules and learned.describe().startswith("reject if ")
    assert rules.fit(rules.statistics(df), labels.filter("quality = 1")).rules == ()
    assert rules.judge(df.limit(0), labels).count() == 0
    kept = rules.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() > 400


def test_verdicts_equal_brute_force(spark):
    """base_failed by the contract's words, kept by the learned conditions one by one, for every row."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    rows = [(i, " ".join(word() + ("#*$" if i % 3 == 0 and rng.random() < 0.4 else "") for _ in range(rng.randrange(30, 120)))) for i in range(300)]
    rows += [(300, "ab cd ef " * 40), (301, None), (302, ""), (302, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(300)] + [(5, None, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    found = rules.fit(rules.statistics(df), labels)
    assert found.rules
    want = Counter()
    for d, t in rows:
        n, chars, symbols, dup, repeat = brute_counts(t)
        failed = n < 50 or 100 * repeat > 50 * n
        x = {"words": n, "mean_word_chars": chars / max(n, 1), "symbols_per_word": symbols / max(n, 1), "dup_lines": dup, "repeat_share": repeat / max(n, 1)}
        hit = any(all((x[c.feature] > c.threshold) == c.above for c in rule) for rule in found.rules)
        want[d, n, failed, not failed and not hit] += 1
    got = Counter((r.doc_id, r.n_words, r.base_failed, r.kept) for r in rules.judge(df, labels).collect())
    assert got == want and len({k[3] for k in want}) == 2


# --- 10 ---


def test_scores(spark):
    docs, df = corpus(spark, 200)
    got = pitmanyor.scores(df).collect()
    assert len(got) == len(docs)
    toks = [(d, [*split(low(t)), None]) for d, t in docs]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    c = Counter(w for d, ws in toks if not held(d) for w in ws)
    total, v = sum(c.values()), len(c)
    for r in got:
        if r.doc_id is None:
            continue
        ws = next(ws for d, ws in toks if d == r.doc_id)
        base = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(ws), sum(c[w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(base) and r.score < 0
    out = [r for r in got if r.held_out]
    assert out and sum(r.score for r in got if not r.held_out) > sum(r.base_score for r in got if not r.held_out)
    assert pitmanyor.scores(df.limit(0)).count() == 0
    nothing = pitmanyor.scores(df.filter("doc_id IN (%s)" % ",".join(str(d) for d, _ in docs if held(d))))
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in nothing.collect())


@pytest.mark.parametrize("hot", [1 << 19, 40])
def test_scores_on_held_out_text(spark, hot):
    """Text of a bigram source: the model beats its own unigrams where it hasn't learned, also with every frequent context spread over groups."""
    rng = random.Random(3)
    names = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    after = {w: rng.sample(names, 4) for w in names}
    rows = []
    for i in range(300):
        w = rng.choice(names)
        text = []
        for _ in range(60):
            text.append(w)
            w = rng.choice(after[w]) if rng.random() < 0.9 else rng.choice(names)
        rows.append((i, " ".join(text)))
    got = pitmanyor.scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hot=hot).collect()
    out = [r for r in got if r.held_out]
    gain = sum(r.score - r.base_score for r in out) / sum(r.n_tokens for r in out)
    assert len(out) > 10 and gain > 0.6  # of log10 60 - log10 4 - what one in ten costs, about 0.8


def test_word_hashes_are_words():
    texts = ["a b  a", "", "\té é\n", "A a"]
    h, n = pitmanyor.word_hashes([t.encode() for t in texts])
    assert n.tolist() == [4, 1, 3, 3]
    assert h[0] == h[2] == h[8] == h[9] and h[0] != h[1] and h[5] == h[6] and h[3] == h[4] == h[7] == h[10] == pitmanyor.END


def test_seats_follow_the_stirling_weights():
    d, base, others, c = 0.5, 0.01, 30.0, 5
    t = np.arange(1, c + 1)
    logs = pitmanyor.stirling(d)[c, t] + np.array([sum(math.log(1 + d * (others + i)) for i in range(k)) for k in t]) + t * math.log(base)
    want = np.exp(logs - logs.max())
    want /= want.sum()
    got = pitmanyor.seat(np.full(40_000, c), np.full(40_000, base), np.full(40_000, others), d, np.random.default_rng(0))
    assert np.abs(np.bincount(got, minlength=c + 1)[1:] / 40_000 - want).max() < 0.01
    many = pitmanyor.seat(np.full(50, 5000), np.full(50, 1e-4), np.full(50, 100.0), d, np.random.default_rng(0))
    assert (many >= 1).all() and (many <= 5000).all()
    for d, base, others, c, many in ((0.6, 0.05, 40.0, 400, 50), (0.8, 0.4, 3.0, 300, 40), (0.3, 1e-3, 1000.0, 500, 60)):  # past the table as within it
        few, all_ = (pitmanyor.seat(np.full(20_000, c), np.full(20_000, base), np.full(20_000, others), d, np.random.default_rng(1), many=m) for m in (many, 512))
        assert few.mean() == pytest.approx(all_.mean(), rel=0.03) and few.std() == pytest.approx(all_.std(), rel=0.1)
    assert math.exp(pitmanyor.stirling(0.0)[4, 2]) == pytest.approx(11)  # without discount: Stirling numbers of the first kind


# --- all ---


def test_operators_on_empty_tables(spark, tmp_path):
    df = corpus(spark)[1].limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    for found in (rules.keep_good(df, labels), simhash.keep_one(df), linededup.drop_repeats(df), fmindex.decontaminate(df, items)):
        assert found.columns == df.columns and found.count() == 0
    full = corpus(spark)[1]
    assert fmindex.decontaminate(full, items).count() == full.count()
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_very_long_texts(spark):
    """Texts of a megabyte: words, lines that repeat, blanks, and one without a blank."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    some = [word() for _ in range(3000)]
    texts = [" ".join(rng.choice(some) for _ in range(170_000)), "\n".join(f"line {i % 5000} of text" for i in range(60_000)), " " * 1_000_000, "".join(rng.choice("abcdefgh") for _ in range(200_000)), "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = len(texts)
    assert simhash.near_duplicates(df).count() == n and simhash.keep_one(df).count() == n
    sections = {r[0]: r[1] for r in tokencounts.count_sections(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).groupBy("doc_id").count().collect()}
    assert sections == {0: 1, 1: 60_000, 2: 1, 3: 1, 4: 1}
    lines = {r.doc_id: (r.n_lines, r.n_removed) for r in linededup.dedup_lines(df).collect()}
    assert lines[1] == (60_000, 55_000) and all(lines[i] == (1, 0) for i in (0, 2, 3, 4))
    items = spark.createDataFrame([(1, " ".join(texts[0].split()[5000:5010]))], "item_id long, text string")
    hits = {r.doc_id: r.n_hit for r in fmindex.digest(fmindex.find(df, items)).collect()}
    assert hits[0] >= 10 and hits[3] == 0
    tokens = packing.read_tokens(packing.token_files(df, public_tokenizers.path("word_bpe_49k.json")), ids=False).collect()
    assert len(tokens) == n and all(r.n_tokens >= 1 for r in tokens)
    cut = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffixdedup.dedup_substrings(df, texts=False).collect()}
    assert all(cut[i] == (len(t), 0) for i, t in enumerate(texts))
    assert all(r.lossless for r in pieces.encode(df, public_tokenizers.path("piece_bpe_32k.model"), ids=False).collect())
    stats = {r.doc_id: (r.n_words, r.n_dup_lines) for r in rules.statistics(df).collect()}
    assert stats[0] == (170_000, 0) and stats[1] == (240_000, 55_000) and stats[2] == (0, 0) and stats[3] == (1, 0)
    scored = {r.doc_id: r.n_tokens for r in pitmanyor.scores(df).collect()}
    assert scored == {0: 170_001, 1: 240_001, 2: 1, 3: 2, 4: 2}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(name, spark, sf_dir, duck):
    assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == duck_rows(duck, queries.ORACLE_SQL[name])


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = common.scratch(spark, f"test-{name}")
        stage(spark, at, sf_dir).write.parquet(path)
        at = spark.read.parquet(path)
        assert at.columns == docs.columns
        kept.append(at.count())
    assert docs.count() >= kept[0] >= kept[1] >= kept[2] >= kept[3] > 0
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    windows = {tuple(w[i : i + 10]) for _, t in items for w in [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))] for i in range(max(1, len(w) - 9))}
    for r in at.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(r.text))
        assert not any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9))
    assert corpus_pipeline.run(spark, sf_dir).filter("lossless").count() == kept[-1]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (None, 3), (2000, 2001), (2000, 2001)]
    few, got = ({r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long"), few=n).collect()} for n in (1000, 0))
    assert few == got and common.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[1000 + i] == 1000 for i in range(1, 50)) and got[2001] == 2000
