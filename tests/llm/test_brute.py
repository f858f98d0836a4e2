"""Each registered query, and the pipeline, against plain Python over whole tables with odd rows and clashing columns."""

import hashlib
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from paywarden.llm import language_id, media, packing, pii, queries, simhash, url_filter, vector_dedup, warc
from paywarden.llm.common import WordTable, free_name, with_row_id

SF = "/root/testdata/sf0.001"
EXTRA = ("rid", "found", "__found", "__rid", "fp", "root", "component_id", "k0", "t", "lang_pred", "score", "kept", "n_bytes", "kind", "set", "no", "file", "row")
ODD = [
    (None, "a text without an id, with a letter", "en"), (None, None, None), (9001, "", "en"), (9001, "", "en"), (9002, " \t\n\x0b ", None), (9003, "12 345, 6!", "de"), (9004, "b" * 5000, "en"), (9005, "word " * 9000, "en"),
    (9006, "word " * 9000, "en"), (9007, "\u65e5\u672c\u8a9e \U0001f600 \u2581x  y \x00z", None), (9008, "pay 4041894974608795 or GB29 NWBK 6016 1331 9268 19 EUR, a.b@c.org 10.1.2.3 +1 (132) 555-1352", "en"), (9011, "mark \uffff 4041894974608795 \uffff, a.b@c.org", "en"), (9009, "the same four words", "fr"), (9009, "the same four words", "fr"), (9010, "THE same\nfour words", "fr"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """All documents of the smallest scale, odd rows, and a column of each name that operators use."""
    out = tmp_path_factory.mktemp("odd")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(i, t, g, "odd", len(t or "")) for i, t, g in ODD], docs.schema)
    docs.unionByName(odd).withColumns({c: F.lit(f"extra {c}") for c in EXTRA}).repartition(3).write.parquet(f"{out}/documents.parquet")
    return str(out)


@pytest.fixture(scope="module")
def rows(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()


def same(got, want):
    """Equal lists of tuples, whatever their order; null ids first."""
    by = lambda r: str(r)
    assert sorted(map(tuple, got), key=by) == sorted(want, key=by)


def test_op1(spark, folder, rows):
    got = queries.op1_language_id(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    langs, prob = language_id.fit(docs, queries.PIECES, language_id.fold_of() != 2)
    pieces, seen = {p: i for i, p in enumerate(language_id.vocabulary(queries.PIECES))}, {}
    want = {(r.doc_id, r.text): brute.language(r.text, langs, pieces, prob, language_id.UNKNOWN, seen) for r in rows}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    same([(r.doc_id, r.lang_pred, round(r.score, 6)) for r in got], [(i, g, round(x, 6)) for (i, t), (g, x) in want.items() for _ in range(sum((r.doc_id, r.text) == (i, t) for r in rows))])


def test_op2(spark, folder, rows):
    fps = [brute.simhash(r.text) for r in rows]
    root = brute.classes(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    least = {}
    for r, c in zip(rows, root):
        if r.doc_id is not None:
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    same(queries.op2_simhash(spark, folder).collect(), [(r.doc_id, f"{f:016x}", least.get(c)) for r, f, c in zip(rows, fps, root)])


@pytest.mark.parametrize("budget,n,chunk", [(4, 10, 4096), (4, 10**9, 4096), (4, 4 * 10**9, 1000), (0, 100, 10), (8, 10, 10)])
def test_op2_shards_hold_each_link(budget, n, chunk):
    """Two fingerprints that differ in `budget` bits agree on all bits of a choice, however the bits lie."""
    rng = np.random.default_rng(budget)
    choice = simhash.layout(n, budget, chunk)
    masks = [sum(((1 << (hi - lo)) - 1) << (64 - hi) for lo, hi in ranges) for ranges in choice]
    assert n < 10**8 or len(choice) > 5
    for _ in range(300):
        diff = sum(1 << int(b) for b in rng.choice(64, budget, replace=False))
        assert any(not diff & m for m in masks)


def test_op2_walk_in_longer_shards(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    v = np.unique(np.concatenate([base, *[base ^ sum(1 << int(b) for b in rng.choice(62, k, replace=False)) for k in (1, 3, 4, 4, 5)]]))
    fps = spark.createDataFrame([(int(x),) for x in v], "fp long")
    linked = lambda edges: {(e.u, e.v) for e in edges.collect()}
    few = linked(simhash.near_links(fps))
    layout = simhash.layout
    monkeypatch.setattr(simhash, "layout", lambda n, budget, chunk: layout(10**9, budget, chunk))
    many = linked(simhash.near_links(fps))
    assert {x for e in few for x in e} == {x for e in many for x in e} and few


def test_op3(spark, folder, rows):
    got = queries.op3_pii(spark, folder).collect()
    want = []
    for r in rows:
        text, found = brute.pseudonyms(r.text or "", pii, queries.OPEN_KEY)
        kinds = [k for k, _, _ in found]
        want.append((r.doc_id, None if r.text is None else text, *[kinds.count(k) for k in pii.PATTERNS]))
    same(got, want)
    assert sum(sum(w[2:]) for w in want) > 20
    with pytest.raises(ValueError):
        pii.pseudonymise(spark.read.parquet(f"{folder}/documents.parquet"))
    kept = pii.pseudonymise(spark.read.parquet(f"{folder}/documents.parquet"), key="k").where("found <> 'extra found' or __found <> 'extra __found'")
    assert kept.count() == 0


def test_op4(spark, folder, rows):
    bodies = [(r.text or "").encode() for r in rows]
    want = []
    for r, b, gone in zip(rows, bodies, brute.cut(bodies)):
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
        want.append((r.doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    same(queries.op4_suffix_array(spark, folder).collect(), want)


def test_op4_long_texts_in_parts(spark, rows, monkeypatch):
    """Texts above a part's size give the same repeats; parts' windows are those of the texts."""
    from paywarden.llm import suffix_dedup

    whole = suffix_dedup.occurrences
    monkeypatch.setattr(suffix_dedup, "occurrences", lambda df, text, width: whole(df, text, width, 1500))
    docs = spark.createDataFrame([(i, r.text) for i, r in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in suffix_dedup.cut_repeats(docs).collect()}
    bodies = [(r.text or "").encode() for r in rows]
    assert all(got[i] == np.frombuffer(b, np.uint8)[~g].tobytes() for i, (b, g) in enumerate(zip(bodies, brute.cut(bodies))))


def test_op8(spark, folder, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    want = []
    for r in rows:
        ids = sp.encode(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    same(queries.op8_pieces(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect(), want)


def test_op9(spark, folder, rows):
    got = queries.op9_media(spark, folder).collect()
    stored = {(r.doc_id, r.n_bytes): r.media for r in media.to_media(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    want = []
    for r in rows:
        b = (r.text or "").encode()
        body = b + b" " * (max(192, -(-len(b) // 192) * 192) - len(b))
        image = np.frombuffer(body, np.uint8).reshape(-1, 192)
        png = stored[r.doc_id, len(b)]
        head, at, idat = png[:33], 33, b""
        assert head[:8] == b"\x89PNG\r\n\x1a\n" and head[12:16] == b"IHDR" and head[16:29] == (192).to_bytes(4, "big") + len(image).to_bytes(4, "big") + b"\x08\0\0\0\0"
        while png[at + 4 : at + 8] == b"IDAT":
            n = int.from_bytes(png[at : at + 4], "big")
            idat += png[at + 8 : at + 8 + n]
            at += 12 + n
        raw = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(len(image), 193)
        assert (raw[:, 0] == media.UP).all() and (np.cumsum(raw[:, 1:], axis=0, dtype=np.uint8) == image).all()
        want.append((r.doc_id, len(b), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:]), len(png), hashlib.sha256(png).hexdigest()))
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
    same([tuple(r[n] for n in names) for r in got], want)
    of = {r.payload_sha256: r.feature for r in got}
    for r in rows[::8] + rows[-3:]:
        body = media.payload((r.text or "").encode())
        assert of[hashlib.sha256(body).hexdigest()] == f"{brute.dct_hash(np.frombuffer(body, np.uint8).reshape(-1, 192)):016x}"


def _pieces_hold(pieces, ids_of, length=2048):
    """Every document's ids lie in its pieces once, and sequences are full and gapless."""
    left = sorted((tuple(ids) for ids in ids_of), key=len)
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for s, parts in by_sequence.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or s == len(by_sequence) - 1
    docs = []
    order = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    for p in order:
        if p.start == 0:
            docs.append([])
        docs[-1].append(p)
    assert sorted(sum(p.length for p in d) for d in docs) == [len(x) for x in left]
    crcs = sorted((d[0].doc_id is None, d[0].doc_id or 0, [(p.start, p.length, p.ids_crc32) for p in d]) for d in docs)
    return crcs


def test_op10(spark, folder, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in rows]
    got = _pieces_hold(queries.op10_packing(spark, folder).collect(), ids)
    left = {}
    for r, x in zip(rows, ids):
        left.setdefault((r.doc_id is None, r.doc_id or 0), []).append(x)
    for none, doc, parts in got:
        fits = [i for i, x in enumerate(left[none, doc]) if all(zlib.crc32(x[s : s + n].tobytes()) == c for s, n, c in parts) and sum(n for _, n, _ in parts) == len(x)]
        left[none, doc].pop(fits[0])
    assert not any(left.values())


def test_packing_ties(spark):
    """Equal texts have equal keys along the curve; each still has its place."""
    docs = spark.createDataFrame([(i, "the same words " * 30) for i in range(200)], "doc_id long, text string").repartition(5)
    pieces = packing.pack(docs, queries.BYTES).collect()
    assert len({p.doc_id for p in pieces}) == 200 and sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_pipeline(spark, folder, rows):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    langs, prob = language_id.fit(docs, queries.PIECES, F.lit(True))
    pieces, seen = {p: i for i, p in enumerate(language_id.vocabulary(queries.PIECES))}, {}
    found = [(r, brute.language(r.text, langs, pieces, prob, language_id.UNKNOWN, seen)) for r in rows]
    kept = [r for r, (g, x) in found if g != "und" and x >= corpus_pipeline.LEAST_SCORE]
    assert 0 < len(rows) - len(kept) < 12
    sets = [set(brute.shingles(r.text, 5)) for r in kept]
    root = brute.classes(len(kept), lambda i, j: brute.near(sets[i], sets[j]))
    best = {}
    for i, c in enumerate(root):
        rank = (kept[i].doc_id is None, kept[i].doc_id or 0, kept[i].text)
        if c not in best or rank < best[c][0]:
            best[c] = (rank, i)
    kept = [kept[i] for _, i in best.values()]
    bodies = [r.text.encode() for r in kept]
    texts = [np.frombuffer(b, np.uint8)[~g].tobytes().decode("utf-8", "ignore") for b, g in zip(bodies, brute.cut(bodies))]
    texts = [brute.pseudonyms(t, pii, queries.OPEN_KEY)[0] for t in texts]
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4") for r, t in zip(kept, texts)}
    assert len(ids) == len(kept)  # of rows with one id, one is left
    out = corpus_pipeline.run(spark, folder).collect()
    got = _pieces_hold(out, list(ids.values()))
    assert {None if none else doc for none, doc, _ in got} == set(ids)
    for none, doc, parts in got:
        x = ids[None if none else doc]
        assert all(zlib.crc32(x[s : s + n].tobytes()) == c for s, n, c in parts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, folder)
        assert empty.count() == 0, name


def test_op5_odd_rows(spark, tmp_path):
    big = "<p>" + "x" * 1500
    pages = [(1, "http://a", big), (7, "http://b", big), (7, "http://b", big), (2, None, None), (None, "", big), (3, "http://x/" + "y" * 100_000, "z" * 3_000_000), (3, "http://x/" + "y" * 100_000, "z" * 3_000_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit("extra") for c in ("digest", "target", "size", "n", "payload", "record_type")})
    got = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read(warc.write(df), 1 << 16).collect()]
    same(got, [(1, "revisit", 7, 1503), (7, "response", None, 1503), (7, "response", None, 1503), (2, "response", None, 0), (None, "revisit", 7, 1503), (3, "response", None, 3_000_000), (3, "response", None, 3_000_000)])


def test_op6_odd_rows(spark):
    v = [1.0, 0.0, 0.5]
    data = [(None, v, 1), (4, v, 1), (4, v, 1), (9, [1.0, 0.001, 0.5], 1), (5, [1.0, 0.0], 1), (6, [1.0, 0.0], 1), (7, [1e-300, 0.0, 5e-301], 1), (8, [1.0, None, 0.5], 1), (2, v, 2)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(0) for c in ("id", "x", "grp", "hx", "rid", "cell", "side", "w", "root")})
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dedup.near_vectors(df).collect()), key=str)
    want = [(None, 4, 4, False), (4, 4, 4, True), (4, 4, 4, True), (9, 4, 4, False), (7, 4, 4, False), (5, 1, 5, True), (6, 1, 5, False), (8, 0, 8, True), (2, 0, 2, True)]
    assert got == sorted(want, key=str)


def test_op6_dense_label(spark):
    """One label of 7,000 vectors, all near copies, at the default parameters: every link counts."""
    rng = np.random.default_rng(11)
    x = (rng.standard_normal(32) + 0.14 * rng.standard_normal((7000, 32))).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = np.concatenate([(unit[i : i + 500] @ unit.T >= 0.98).sum(axis=1) for i in range(0, 7000, 500)]) - 1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_vectors(df).collect()}
    assert 7000 < links.sum() < 48e6
    assert [got[i][0] for i in range(7000)] == links.tolist()


def test_op6_sparse_shards_are_audited():
    """A shard whose only link lies off the probes' places: the audit has nothing to go by, so all pairs are compared."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 24))
    x[501] = x[277] + 0.05 * rng.standard_normal(24)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert [(int(a[0]), int(b[0])) for a, b in vector_dedup.shard_pairs(x, 0.98) if len(a)] == [(277, 501)]


def test_op6_search_is_bounded_and_checked(monkeypatch):
    """Two clumps of 500 near copies among 5,000 vectors: few pairs are visited, the graph alone finds most links, the check after it the rest."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((5000, 64))
    for at in (0, 500):
        x[at : at + 500] = x[at] + 0.1 * rng.standard_normal((500, 64))
    x = x[rng.permutation(5000)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    truth = np.triu(x @ x.T >= 0.98, 1)
    search, visited = vector_dedup.expand, []

    def expand(*args):
        out = search(*args)
        visited.append(len(out[0]))
        assert sum(visited) < 200 * len(x)
        return out

    monkeypatch.setattr(vector_dedup, "expand", expand)
    found = np.zeros_like(truth)
    for a, b in vector_dedup.shard_pairs(x, 0.98):
        assert not found[a, b].any()
        found[a, b] = True
    assert np.array_equal(found, truth)
    visited.clear()
    graph = np.zeros_like(truth)
    for _, a, b in vector_dedup.graph_pairs(x.astype(np.float32), 0.98):
        graph[np.minimum(a, b), np.maximum(a, b)] = True
    recall = (graph & truth).sum() / truth.sum()
    assert 0.9 < recall < 1


def test_op7_odd_rows(spark):
    long = "http://example.com/en/7/" + "a/?" * 5 + "b" * 300_000
    urls = ["http://example.com/en/7", "http://example.com/en/7", None, "://", "x", long, "http://" + "h" * 200_000 + ".org/es/1", "http://" + "h" * 200_000]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumns({c: F.lit("extra") for c in ("host", "path", "rule", "verdict", "line", "k0")})
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got == {0: ("example.com/en/7", "allow"), 1: ("example.com/en/7", "allow"), 2: (None, "allow"), 3: (None, "allow"), 4: (None, "allow"), 5: ("example.com/en/7", "allow"), 6: ("org/es/", "block"), 7: (None, "allow")}
    assert url_filter.judge(df.limit(0)).count() == 0


def test_word_table_keeps_short_words_only():
    table = WordTable(lambda ws: (np.concatenate([np.full(len(w), len(w)) for w in ws]), np.array([len(w) for w in ws])), most=5, longest=10)
    for words in (["a", "b" * 50, "cc"], ["cc", "d" * 99, "a", "eee"], ["f" * 4] * 3 + ["g"], ["h", "a"], ["i" * 30]):
        flat, sizes = table.gather(table.numbers(words))
        assert sizes.tolist() == [len(w) for w in words] and flat.tolist() == [len(w) for w in words for _ in w]
    assert set(table.index) <= {"a", "cc", "eee", "ffff", "g"} and max(map(len, table.index)) <= 10


def test_row_ids(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    name = free_name(docs, "rid")
    assert name not in docs.columns
    for most in (20_000, 0):  # by the files' numbers, or stored where there are too many files
        rows = with_row_id(docs, name, most)
        assert rows.select(name).distinct().count() == docs.count() and rows.where("file = 'extra file'").count() == docs.count()
