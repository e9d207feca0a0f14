"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on odd rows."""

import hashlib
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from tidewater.llm import ann, bpe, chat, langid, lz, mixing, ngram_join, pii, queries, token_counts, warc
from tidewater.llm.common import range_of, ranges, table, work_dir

SMALL = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

#: Nulls in all columns, empty and repeated rows, ties, a very long text.
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one", "en", "a", 3), (3, "one", "en", "a", 3), (None, "the cat sat on the mat", None, "b", 1), (None, None, None, None, None), (5, "ab " * 30000, "fr", None, 90000), (6, "  \n\t ", "en", "b", 5), (7, "x" * 50000, "de", "c", 1), (3, "another text of three", "en", "a", 3)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SMALL, "documents")


def rows(df):
    return Counter(map(tuple, df.collect()))


# --- 1: byte-level BPE ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.TextEncoder(RANKS, public_tokenizers.PATTERN)


def test_bpe_is_the_librarys(encoder, reference):
    draw = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "1", "é", "日", "😀", "'s", "'re", "'", "!", "\t", "th", "ing", "====", " ", "\x1c", "\x85", "²", "'ll", "Z"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 40))) for _ in range(3000)] + ["a" * 5000, " " * 3000 + "x", "ab" * 3000]
    for text, ids in zip(texts, encoder.encode_all(texts), strict=True):
        assert ids.tolist() == reference.encode_ordinary(text)
        assert encoder.decode_array(ids).decode() == text


def test_bpe_by_another_pattern(encoder, reference):
    other = bpe.TextEncoder(RANKS, public_tokenizers.PATTERN + "|(?!)")  # splits by the expression itself
    texts = ["It's 12 o'clock,  isn't it?\n\n ok", "", "é ß"]
    assert [x.tolist() for x in other.encode_all(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_bpe_appends_and_edits(encoder):
    draw, b = random.Random(2), encoder.bpe
    for _ in range(200):
        data = bytes(draw.choices(b"abcdthing eers", k=draw.randint(1, 30)))
        cells = b.table(data)
        data, cells = b.append(data, cells, b"ing")
        assert b.ids(cells) == b.ids(b.table(data))
        at = draw.randint(0, len(data))
        data, cells = b.edit(data, cells, at, min(len(data), at + 2), b"the")
        assert b.ids(cells) == b.ids(b.table(data)) and b.decode(b.ids(cells)) == data


def test_bpe_edits_stop_where_cells_agree_again(encoder):
    b, data = encoder.bpe, b"abcdthing eers" * 2000
    cells = b.table(data)
    filled = []
    table = b.table
    b.table = lambda d, c=None: filled.append(len(d)) or table(d, c)
    try:
        after, cells = b.edit(data, cells, 100, 103, b"xyzw")
    finally:
        del b.table
    assert max(filled) < 100 + 5 * b.longest and cells == table(after)


def test_bpe_documents_under_edits(encoder, reference):
    draw = random.Random(23)
    parts = ["a", "the", " ", "  ", "\n", "12", "é", "日", "'s", "'", "!", "\t ", "ing", " word", "====", "😀"]
    text = "".join(draw.choices(parts, k=400))
    doc = bpe.Document(encoder.bpe, public_tokenizers.PATTERN, text)
    assert doc.ids() == reference.encode_ordinary(text)
    for _ in range(400):
        at = draw.randint(0, len(text))
        end = min(len(text), at + draw.choice([0, 0, 1, 3, 30]))
        put = "".join(draw.choices(parts, k=draw.randint(0, 5)))
        if draw.random() < 0.2:
            at = end = len(text)
        text = text[:at] + put + text[end:]
        made = doc.append(put) if at == end == len(doc.text) else doc.edit(at, end, put)
        assert doc.text == text and doc.ids() == reference.encode_ordinary(text) and made < 30
    empty = bpe.Document(encoder.bpe, public_tokenizers.PATTERN)
    assert empty.ids() == [] and empty.append("") == 0 and empty.append("hello") == 1


def test_bpe_frame(spark, docs, odd, none, reference):
    for df in (docs, odd, none):
        want = Counter()
        for r in df.collect():
            text, ids = r.text or "", reference.encode_ordinary(r.text or "")
            want[(r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
        assert rows(bpe.encode_frame(df, RANKS, public_tokenizers.PATTERN)) == want


# --- 2: mixing ------------------------------------------------------------------------------


def test_mixing_is_the_sqls(spark, tmp_path):
    draw = random.Random(3)
    data = [(i, " ".join("w" * draw.randint(1, 30)), None, draw.choice(["a", "b", "c", "é", None, "d"] + ["a"] * 20), 0) for i in range(300)] + ODD
    spark.createDataFrame(data, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op2_mixing(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(f"SELECT {', '.join(out.columns)} FROM ({mixing.SQL})").fetchall()
    assert rows(out) == Counter(want)
    again = queries.op2_mixing(spark, str(tmp_path))
    assert rows(again) == rows(out)
    assert all(r.taken <= 3 * r.size for r in out.collect())


def test_mixing_ranges_grow_with_the_rows():
    assert [mixing.digits(n) for n in (0, 10**6, 4 * 10**8, 5 * 10**8, 10**10)] == [3, 3, 3, 4, 5]


def test_mixing_targets_by_simple_resharing(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, "d": 1, "e": 0, None: 40}
    found = {r.source: r.target for r in mixing.targets(spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size bigint")).collect()}
    names = ["a", "b", "c", "d", "e", None]
    w, target, left, free = {n: i % 3 + 1 for i, n in enumerate(names)}, {}, sum(sizes.values()), set(names)
    while True:
        share = {n: left * w[n] / sum(w[m] for m in free) for n in free}
        over = [n for n in free if share[n] > 3 * sizes[n]]
        if not over:
            target |= share
            break
        for n in over:
            target[n] = 3 * sizes[n]
            left -= target[n]
            free.discard(n)
    assert found == pytest.approx(target)


def test_mixing_sequence_keeps_clashing_columns(spark, odd, none):
    df = odd.withColumn("size", F.lit("mine")).withColumn("target", F.lit(1)).withColumn("position", F.lit(2))
    out = mixing.mix(df, mixing.words(F.col("text")))
    assert out.columns == df.columns and {r.size for r in out.collect()} == {"mine"}
    assert mixing.mix(none, mixing.words(F.col("text"))).count() == 0


def test_mixing_positions_follow_the_schedule(spark):
    pieces = mixing._pieces(((0.0, 2.0), (0.5, 0.0), (1.0, 4.0)))
    got = spark.createDataFrame([(x / 10,) for x in range(16)], "d double").select("d", mixing.moment(pieces, F.col("d")).alias("t")).collect()
    for r in got:
        t = r.t
        area = 2 * t - 2 * t * t if t <= 0.5 else 0.5 + 4 * (t - 0.5) ** 2
        assert area == pytest.approx(r.d, abs=1e-9)


# --- 3: n-gram join -------------------------------------------------------------------------


def brute_groups(items, words=4, percent=85):
    sets = [(i, ngram_join.shingles((t or "").encode(), words)) for i, t in items]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for a, (i, s) in enumerate(sets):
        if s and i is not None:
            least[root(a)] = min(least.get(root(a), i), i)
    return Counter((i, len(s), least.get(root(a)) if s else i) for a, (i, s) in enumerate(sets))


def variants():
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefgh", k=3))
    out, n = [], 0
    for size in (2, 3, 5, 7, 12, 20, 40, 70, 130, 260, 500):
        for _ in range(3):
            base = [word() for _ in range(size)]
            for edits in (0, 0, 1, 1, 2, 4, 8, 16, 30):
                text = list(base)
                for _ in range(edits):
                    at = draw.randrange(len(text))
                    text[at : at + 1] = draw.choice([[word()], [], [word(), word()]]) or ([word()] if len(text) == 1 else [])
                out.append((n, " ".join(text)))
                n += 1
    return out


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_ngram_groups_are_brute_forces(spark, words, percent):
    data = variants() + [(10_000, None), (10_001, ""), (10_002, " \n"), (10_003, "A b"), (10_004, "a  B"), (10_004, "a  B")]
    out = ngram_join.near_groups(spark.createDataFrame(data, "doc_id bigint, text string"), words=words, percent=percent)
    assert rows(out) == brute_groups(data, words, percent)


def test_ngram_large_group_of_near_copies(spark):
    """Hundreds of copies that differ from one another: each pair is near the limit, all hang together."""
    draw = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    data = []
    for i in range(300):
        text = list(base)
        for _ in range(draw.randint(0, 2)):
            text[draw.randrange(120)] = f"x{draw.randrange(10**6)}"
        data.append((i, " ".join(text)))
    out = ngram_join.near_groups(spark.createDataFrame(data, "doc_id bigint, text string"))
    assert rows(out) == brute_groups(data)


def test_ngram_group_whose_members_do_not_link(spark, monkeypatch):
    """A thousand texts of one template, most too far from one another; blocks are small, so that keys are cut into many."""
    monkeypatch.setattr(ngram_join, "BLOCK", 100)
    monkeypatch.setattr(ngram_join, "MEMBERS", 20)
    draw = random.Random(16)
    base = [f"w{i}" for i in range(150)]
    data = []
    for i in range(1000):
        text = list(base)
        for at in draw.sample(range(150), draw.choice([0, 1, 2, 3, 4, 5, 5, 5, 6, 6, 6])):
            text[at] = f"x{draw.randrange(300)}"
        data.append((i, " ".join(text)))
    made = []
    compare = ngram_join._compare
    monkeypatch.setattr(ngram_join, "_compare", lambda work, pairs, *rest: made.append(pairs.count()) or compare(work, pairs, *rest))
    assert rows(ngram_join.near_groups(spark.createDataFrame(data, "doc_id bigint, text string"))) == brute_groups(data)
    assert sum(made) < 15 * len(data)  # of half a million


def test_ngram_sketches_bound_the_difference():
    draw, band = np.random.default_rng(17), ngram_join.Band(8, ngram_join.Limit(85))
    for _ in range(300):
        u = draw.integers(0, 1 << 63, int(draw.integers(256, 511)), dtype=np.uint64)
        gone, more = int(draw.integers(0, 60)), draw.integers(0, 1 << 63, int(draw.integers(0, 60)), dtype=np.uint64)
        other = np.concatenate([u[gone:], more])
        a, b = ngram_join.bits(np.concatenate([u, other]), np.array([len(u), len(other)]), band)
        distance, differ = int(np.bitwise_count(a ^ b).sum()), gone + len(more)
        assert distance <= differ and distance >= 0.8 * differ and (differ - distance) % 2 == 0


def test_ngram_blocks_span_what_is_possible():
    draw, limit = np.random.default_rng(18), ngram_join.Limit(85)
    sketch = draw.integers(0, 4, (200, 2), dtype=np.uint64)  # distances of 0 to 4
    n, label, chunk = np.full(200, 20), draw.integers(0, 150, 200), draw.integers(0, 2, 200)
    for parts in (np.zeros(200, int), chunk):
        a, b = ngram_join.possible(sketch, n, label, parts, limit, True)
        want = {(i, j) for i in range(200) for j in range(i + 1, 200) if label[i] != label[j] and (parts is not chunk or chunk[i] != chunk[j]) and int(np.bitwise_count(sketch[i] ^ sketch[j]).sum()) <= limit.differ(20, 20)}
        assert set(zip(a.tolist(), b.tolist())) == want
        forest = ngram_join.possible(sketch, n, label, parts, limit, False)
        assert len(forest[0]) < 200 and {(min(x), max(x)) for x in zip(*(f.tolist() for f in forest))} <= want

        def count(pairs):
            root = list(range(150))

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for i, j in pairs:
                root[find(label[i])] = find(label[j])
            return len({find(x) for x in label})

        assert count(zip(*forest)) == count(want)


def test_ngram_links_are_brute_forces(spark):
    """Also between texts that already are in one component."""
    draw = random.Random(15)
    data = variants() + [(10_000, None), (10_001, ""), (10_003, "A b"), (10_004, "a  B"), (10_004, "a  B")]
    for i in range(60):
        text = [f"w{j}" for j in range(120)]
        for _ in range(draw.randint(0, 2)):
            text[draw.randrange(120)] = f"x{draw.randrange(10**6)}"
        data.append((20_000 + i, " ".join(text)))
    sets = [ngram_join.shingles((t or "").encode(), 4) for _, t in data]
    want = Counter((i, sum(bool(s) and n != m and 100 * len(s & o) >= 85 * len(s | o) for m, o in enumerate(sets))) for n, ((i, _), s) in enumerate(zip(data, sets, strict=True)))
    assert rows(ngram_join.near_links(spark.createDataFrame(data, "doc_id bigint, text string"))) == want


def test_ngram_keys_lose_no_pair():
    draw, limit = np.random.default_rng(7), ngram_join.Limit(85)
    for _ in range(3000):
        union = int(np.exp(draw.uniform(np.log(7), np.log(700))))
        shared = -(-85 * union // 100)
        own = int(draw.integers(0, union - shared + 1))
        if shared == union:
            continue
        u = draw.integers(0, 1 << 63, union, dtype=np.uint64)
        a, b = u[: shared + own], np.concatenate([u[:shared], u[shared + own :]])
        keys, of = ngram_join._flat_keys(np.concatenate([a, b]), np.array([len(a), len(b)]), limit)
        least = min(len(a), len(b))
        assert len(set(keys[of == 0].tolist()) & set(keys[of == 1].tolist())) >= (1 if least < 64 else 2 if least < 128 else 3)


def test_ngram_odd_rows_and_one_of_each(spark, odd, none):
    assert rows(ngram_join.near_groups(odd)) == brute_groups([(r[0], r[1]) for r in ODD])
    assert ngram_join.near_groups(none).count() == 0 and ngram_join.one_of_each(none).count() == 0
    more = ["label", "n", "__key", "__id", "row", "first_id", "nth"]
    kept = ngram_join.one_of_each(odd.withColumns({c: F.lit(1) for c in more}))
    assert kept.columns == [*odd.columns, *more]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter({(r[0], r[1]) for r in ODD})


# --- 4: chat --------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    draw = random.Random(8)
    parts = ["<", "|", "\\", "[", "INST]", "/INST]", "/s>", "s>", "x", "<|turn|>", "<|says|>", "<|done|>", "é😀", "\n", "</s>[INST] ok [/INST]"]
    text = lambda: draw.choice([None, "", *["".join(draw.choices(parts, k=draw.randint(1, 9)))] * 6])
    data = [(draw.choice([None, *range(20)]), draw.choice([None, 0, 1, 2, 2, 3]), draw.choice(["user", "assistant", "assistant", "system", None, "to<|says|>ol"]), text()) for _ in range(400)]
    out = {r.conv_id: r for r in chat.read_frame(chat.format_frame(spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(1)), at_once=200)).collect()}
    want = {}
    low = lambda x: (x is not None, x if x is not None else 0)
    text_low = lambda x: (x is not None, x if x is not None else "")
    for c, t, r, x in sorted(data, key=lambda d: (low(d[0]), low(d[1]), text_low(d[2]), text_low(d[3]).__class__((text_low(d[3])[0], text_low(d[3])[1].encode())))):
        want.setdefault(c, []).append((r or "", x or ""))
    assert out.keys() == want.keys()
    for c, turns in want.items():
        learned = "".join(x for r, x in turns if r == "assistant")
        assert (out[c].n_turns, out[c].turns_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest())
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_chat_escapes():
    draw = random.Random(9)
    for _ in range(20_000):
        s = "".join(draw.choices(["<", "|", "\\", "[", "INST]", "/INST]", "/s>", "s>", "x", "<|"], k=draw.randint(0, 8)))
        e = chat.escape(s)
        assert chat.unescape(e) == s and not re.search(r"<\||</?s>|\[/?INST\]", e)


def test_chat_empty(spark):
    assert chat.read_frame(chat.format_frame(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))).count() == 0


# --- 5: nearest neighbours ------------------------------------------------------------------


def brute_nearest(items, asked, k):
    fine = [(i, np.array(v, float)) for i, v in items if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, v in fine:
        if q in asked:
            best = sorted({(-float(v @ x), i) for i, x in fine if i != q})[:k]
            out[q] = [(i, -s) for s, i in best]
    return out


def test_ann_recall_and_exact_scores(spark):
    draw = np.random.default_rng(10)
    vectors = draw.normal(size=(3000, 24)).astype(np.float32)
    vectors[100:500] = vectors[100]  # a common vector: ties go to smaller ids
    vectors[500:900] = vectors[500] + draw.normal(scale=1e-4, size=(400, 24))
    items = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(items, "vec_id bigint, embedding array<float>")
    out = ann.search(df, df.where("vec_id % 20 = 0"), block=700)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute_nearest(items, set(range(0, 3000, 20)), 20)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.97 * 20 * len(want)
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and len(found) == 20
        assert all(abs(s - float(vectors[q].astype(float) @ vectors[i].astype(float))) < 1e-12 for i, s in found)
    assert [i for i, _ in got[100]] == [i for i, _ in want[100]]


def test_ann_odd_rows(spark):
    shape = "vec_id bigint, embedding array<float>, score string, rank int"
    data = [(0, [1.0, 0.0, 0.5]), (20, [0.9, 0.1, 0.0]), (2, None), (3, []), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 0.0]), (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (8, [1.0, 1.0]), (9, [-1.0, 0.0, 0.0]), (9, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in data], shape)
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [20, 9], 20: [0, 9]}
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


# --- 6: token counts ------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts_and_cache(spark, docs, odd, none, name):
    path, cache = public_tokenizers.path(name), work_dir(spark, "cache")
    count = token_counts.counter(path)
    for df in (odd, docs, none, docs):
        out = token_counts.count_tokens(df.withColumn("digest", F.lit(1)).withColumn("n_tokens", F.lit("x")), path, cache)
        want = Counter((r.doc_id, len((r.text or "").encode()), (n := count([r.text or ""])[0]), n > 4096) for r in df.collect())
        assert rows(out) == want
    stored = spark.read.parquet(cache)
    texts = {r.text or "" for r in docs.unionByName(odd).collect()}
    assert stored.count() == len(texts)  # each text was encoded once, in whichever run came first


def test_token_counts_are_the_librarys():
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["", "a  b", "<s> </s> <unk>", "日本\x00é"]
    assert token_counts.counter(public_tokenizers.path("piece_bpe_32k.model"))(texts) == [len(model.encode(t)) for t in texts]


# --- 7: WARC --------------------------------------------------------------------------------


def test_warc_is_the_sqls(spark, tmp_path):
    draw = random.Random(11)
    html = ["x" * 1000, "é" * 500, "y" * 999, None, "", "z" * 5000]
    data = [(i, draw.choice(["http://a/b c", None, "http://é/\r\n"]), draw.choice(html)) for i in range(200)]
    spark.createDataFrame(data, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert rows(queries.op7_warc(spark, str(tmp_path))) == Counter(con.sql(warc.SQL).fetchall())


def test_warc_rolls_commits_and_reads_back(spark):
    data = [(1, "u", "x" * 2000), (1, "v", "x" * 2000), (2, "u", "x" * 2000), (None, "u", "x" * 2000), (3, None, None), (None, "q", "y" * 1000), (5, "w", "é" * 600)]
    df, folder = spark.createDataFrame(data, "page_id bigint, url string, html string").withColumn("digest", F.lit(1)), work_dir(spark, "warc")
    files = warc.write(df, folder, roll=400)
    assert len({f["name"] for f in files}) == len(files) > 3 and sum(f["records"] for f in files) == len(data)
    out = warc.read(spark, folder, payloads=True).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in out) == Counter({(2, "response", None): 1, (1, "revisit", 2): 2, (None, "revisit", 2): 1, (3, "response", None): 1, (None, "response", None): 1, (5, "response", None): 1})
    assert {r.html for r in out if r.page_id == 5} == {"é" * 600}
    with pytest.raises(OSError):
        warc.write(df, folder)  # it is committed
    empty = work_dir(spark, "warc")
    assert warc.write(df.limit(0), empty) == [] and warc.read(spark, empty).count() == 0


def test_warc_is_the_same_again(spark):
    """However the pages are dealt; also where one page and null pages have too much for a range."""
    draw = random.Random(20)
    pages = [None, 7, 7, -5, 2**62, *range(300)]
    data = [(draw.choice(pages), f"http://a/{i}", draw.choice(["x", "é", "<p>"]) * draw.randint(0, 3000)) for i in range(900)] + [(4, "u", "y" * 2000)] * 20
    df = spark.createDataFrame(data, "page_id bigint, url string, html string")
    first, again = (work_dir(spark, "warc") for _ in range(2))
    files = warc.write(df, first, roll=5_000)
    assert len(files) > 30 and files == warc.write(df.repartition(13), again, roll=5_000)
    out = warc.read(spark, again)
    assert out.count() == len(data) and rows(out) == rows(warc.read(spark, first))


def test_warc_long_records_and_lost_attempts(spark):
    draw = random.Random(21)
    long = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz ", k=4_000_000))
    data = [(1, "u", long), (2, "v", "short"), (3, "w", long[:-1]), (4, "x", long)]
    folder = work_dir(spark, "warc")
    system, path = warc.open_folder(f"{folder}/tmp")
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/00000-00000-lost") as lost:
        lost.write(b"half a record")  # what an attempt left that didn't succeed
    files = warc.write(spark.createDataFrame(data, "page_id bigint, url string, html string"), folder)
    assert sum(f["records"] for f in files) == 4
    out = {r.page_id: r for r in warc.read(spark, folder, payloads=True).collect()}
    assert out[3].html == long[:-1] and out[4].html == long and out[2].html == "short"
    assert (out[1].record_type, out[1].refers_to, out[1].payload_bytes) == ("revisit", 4, len(long))
    assert not system.get_file_info(path).is_file and system.get_file_info(path).type.name == "NotFound"


def test_ranges_follow_the_rows(spark):
    draw = random.Random(22)
    data = [(draw.choice([draw.randrange(100), draw.randrange(10**15), -(2**63), 5]), draw.randint(0, 50)) for _ in range(3000)] + [(2**63 - 1, 9)]
    df = spark.createDataFrame(data, "at bigint, n bigint")
    starts = ranges(df, 2000)
    assert starts.tolist() == ranges(df.repartition(9), 2000).tolist() and list(starts) == sorted(set(starts.tolist()))
    sums, values = Counter(), {}
    for r in df.select("at", "n", range_of(F.col("at"), starts).alias("k")).collect():
        assert starts[r.k] <= r.at and (r.k + 1 == len(starts) or r.at < starts[r.k + 1])
        sums[r.k] += r.n
        values.setdefault(r.k, set()).add(r.at)
    assert all(n <= 2000 or len(values[k]) == 1 for k, n in sums.items()) and len(sums) == len(starts)
    assert len(ranges(df.limit(0), 10)) == 0 and len(ranges(df.limit(1), 10, 48)) == 1


# --- 8: personal data -----------------------------------------------------------------------

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_are_the_forms():
    draw = random.Random(12)
    for _ in range(20_000):
        s = "".join(draw.choices("ab@..--+1239 ()é%_@", k=draw.randint(0, 40)))
        assert pii.base_spans(s) == brute_spans(s)


def test_pii_finds_base_and_contextual_spans(spark, docs, odd, none):
    for df in (docs, odd, none):
        want = Counter()
        for r in df.collect():
            spans = brute_spans(r.text or "")
            joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
            want[(r.doc_id, *(sum(s[0] == k for s in spans) for k in FORMS), hashlib.sha256(joined.encode()).hexdigest())] += 1
        assert rows(pii.find(df).drop("spans")) == want
    draw = random.Random(13)
    data = [(i, f"Some words go here. please write to me at {draw.choice(['bob', 'eve'])}{i}@mail.example.com for more") for i in range(40)] + [(100 + i, f"Some words. please write to me at eve_{12345 + i} for more") for i in range(5)] + [(200, "a number 12345 in other words")]
    found = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(data, "doc_id bigint, text string")).collect()}
    assert all(found[100 + i].startswith("ctx_email:") for i in range(5)) and found[200] == ""
    assert all(found[i].startswith("email:") and "," not in found[i] for i in range(40))


@pytest.mark.parametrize("text, want", [("eve [at] mail [dot] com", "eve [at] mail [dot] com"), ("ask eve(at)mail(dot)com now", "eve(at)mail(dot)com"), ("eve at mail dot com.", "eve at mail dot com"), ("to eve7 at mail dot example dot com, please", "eve7 at mail dot example dot com"), ("call (555) 123-4567.", "(555) 123-4567"), ("call 555 123 4567, or", "555 123 4567"), ("no (555 123 4567) of", "(555 123 4567)"), ("id 12 345 1.2.3.4 9", "12 345"), ("x 12345, y", "12345"), ("٠١٢٣٤ x", "٠١٢٣٤"), ("a 1 b 22", None)])
def test_candidates_are_whole(text, want):
    found = [text[a:b] for a, b, whole in pii.candidates(text, pii.base_spans(text)) if whole]
    assert found == ([want] if want else [])


def test_candidates_of_long_words_in_linear_time():
    for text in ("at" * 50000 + "dot", "xat" + "adot" * 20000 + "_", "5)(" * 30000, "1 " * 50000, "5" + "!" * 50000, "at(dot " * 20000):
        before = time.process_time()
        list(pii.candidates(text, pii.base_spans(text)))
        assert time.process_time() - before < 10


@pytest.mark.parametrize("text, value, want", [("b@x.de is my address", "b@x.de", ["R is"]), ("x" * 100 + " b@x.de", "b@x.de", [f"L {'x' * 60}"]), ("x" * 100 + ":b@x.de. Ok", "b@x.de", [f"L {'x' * 59}:", f"B {'x' * 59}: _ .", "R . ok"]), ("a b c1 b@x.de" + " " * 99 + "d", "b@x.de", ["L b c0", "B b c0 _ d", "R d"]), ("b@x.de.", "b@x.de", [])])
def test_pii_contexts(text, value, want):
    a = text.index(value)
    assert pii.contexts(text, a, a + len(value)) == want


def brute_bootstrap(texts, support=5, sure=0.6, share=0.55):
    """All spans that patterns find, by simple rounds."""
    places, edges, kinds = [], {}, {}
    for text in texts:
        base = pii.base_spans(text)
        for kind, a, b, whole in [*((*s, True) for s in base), *((None, *s) for s in pii.candidates(text, base))]:
            value = text[a:b].lower()
            if kind:
                kinds[value] = max(kind, kinds.get(value, kind))
            for c in pii.contexts(text, a, b):
                if whole:
                    edges.setdefault(c, set()).add(value)
                if kind is None:
                    places.append((text, a, b, c))
    known, trusted = {v: (10**6, k) for v, k in kinds.items() if any(v in e for e in edges.values())}, {}
    while True:
        new = {}
        for pattern, values in edges.items():
            n, found = len(values), {}
            for v in values:
                if v in known:
                    found.setdefault(known[v][1], []).append(known[v][0])
            able = []
            for kind, ps in found.items():
                p, z2 = len(ps) / n, 1.96**2
                low = (p + z2 / (2 * n) - (z2 * (p * (1 - p) / n + z2 / (4 * n * n))) ** 0.5) / (1 + z2 / n)
                if len(ps) >= support and sum(ps) // (n + 1) >= sure * 10**6 and low >= share:
                    able.append((sum(ps) // (n + 1), kind))
            if able and n >= support and pattern not in trusted:
                new[pattern] = max(able)
        if not new:
            break
        trusted |= new
        for v in {v for p in new for v in edges[p]} - known.keys():
            known[v] = max(s for p, s in new.items() if v in edges[p])
    spans = {}
    for text, a, b, c in places:
        if c in trusted:
            spans.setdefault((text, a, b), []).append(trusted[c])
    return Counter((hashlib.sha256(t.encode()).hexdigest()[:32], f"ctx_{max(s)[1]}", a, b) for (t, a, b), s in spans.items())


def test_pii_bootstrap_is_brute_forces(spark):
    draw = random.Random(19)
    lead = ["write to", "call me at", "my login:", "the code", "pay with", "ask for", "sent by"]
    data = []
    for i in range(1500):
        k = draw.randrange(len(lead))
        value = [f"u{i % 90}@mail.example.com", f"+1 555 010 {1000 + i % 80}", f"name_{1000 + i % 60}", f"k{10000 + draw.randrange(400)}", f"10.0.{i % 9}.{i % 200}", f"name_{1000 + draw.randrange(90)}", f"u{i % 90}@mail.example.com"]
        data.append(f"{draw.choice(['so', 'then', 'a b'])} {lead[k] if draw.random() < 0.9 else draw.choice(lead)} {value[k] if draw.random() < 0.8 else draw.choice(value)} {draw.choice(['', 'now', '. ok', 'or not'])}")
    df = spark.createDataFrame([(x,) for x in data + [None, ""]], "text string")
    want = brute_bootstrap(sorted(set(data)))
    assert want and rows(pii.bootstrap(df)) == want
    assert rows(pii.bootstrap(df.repartition(7))) == want


def test_pii_values_found_lead_to_further_patterns(spark):
    names = [f"name_{1000 + i}" for i in range(10)]
    data = [f"Some text. my contact mail: user{i}@mail.example.com is mine" for i in range(30)]
    data += [f"Other text. my contact mail: {v} is mine" for v in names]
    data += [f"And then the backup login id: {v} was made" for v in names]
    data += ["And then the backup login id: unseen_987654 was made", "It cost 123456 in all", "the room 20199 then"]
    found = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(list(enumerate(data)), "doc_id bigint, text string")).collect()}
    at = data[50].index("unseen")
    assert found[50] == f"ctx_email:{at}:{at + 13}" and found[51] == found[52] == ""
    assert all(found[i].startswith("ctx_email:") for i in range(30, 50))


def test_pii_finds_what_only_follows(spark):
    data = [(i, f"user{i}@mail.example.com is their address {i}") for i in range(40)] + [(100 + i, f"eve_{12345 + i} is her name") for i in range(3)]
    found = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(data, "doc_id bigint, text string")).collect()}
    assert all(found[100 + i] == "ctx_email:0:9" for i in range(3))


def test_pii_finds_values_of_several_words(spark):
    seeds = [(i, f"Some words. please write to me at bob{i}@mail.example.com for more") for i in range(40)]
    forms = ["eve [at] mail [dot] com", "eve(at)mail(dot)com", "eve at mail dot example dot org", "(555) 123-4567", "555 123 4567"]
    data = seeds + [(100 + i, f"Some words. please write to me at {v} for more") for i, v in enumerate(forms)]
    found = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(data, "doc_id bigint, text string")).collect()}
    for i, v in enumerate(forms):
        assert f"ctx_email:34:{34 + len(v)}" in found[100 + i].split(",")


def test_redaction(spark, odd):
    assert pii.redact("a b@c.de f", "email:2:8") == "a <EMAIL> f"
    assert pii.redact("abcdef", "card:1:4,phone:2:5") == "a<CARD>f"
    df = odd.withColumn("row", F.lit(1)).withColumn("spans", F.lit("x"))
    out = pii.redact_frame(df)
    assert out.columns == df.columns and rows(out) == rows(df)


# --- 9: language ----------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    out = queries.op9_language_id(spark, "/root/testdata/sf0.01").collect()
    langs = {r.doc_id: r.lang for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    held = [r for r in out if r.held_out]
    assert len(held) > 200 and sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out) and sum(r.rejected for r in out) < 0.01 * len(out)


@pytest.mark.parametrize("learned", [["de", "en", "es", "fr"], ["de", "en", "fr"], ["en", "fr"], ["en"]])
def test_language_rejects_what_it_has_not_learned(spark, learned):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    model = langid.fit(docs.where(F.col("lang").isin(learned) & ~langid.held_out(F.col("doc_id"))))
    held = docs.where(langid.held_out(F.col("doc_id")))
    out = langid.predict(held.select("lang", "text", F.lit(1).alias("rejected_before")), model, keep=("lang", "rejected_before")).collect()
    right = [r for r in out if r.lang == r.lang_pred]
    assert len(right) > 1000 and sum(r.rejected for r in right) <= 0.001 * len(right)
    if len(learned) > 1:
        unseen = [r for r in out if r.lang not in learned]
        assert sum(r.rejected for r in unseen) >= 0.97 * len(unseen)
    others = ["これは日本語の文章です。今日は天気がいいので散歩に行きました。", "Это русский текст, который написан для проверки определения языка.", "asdkjh qwoieu zmxncb qpwoei alskdj zxmcnb qweoiu asdlkj xcvmnb"]
    assert all(r.rejected for r in langid.predict(spark.createDataFrame([(i, x) for i, x in enumerate(others)], "doc_id bigint, text string"), model).collect())


def test_language_odd_rows(spark, docs, odd, none):
    model = langid.fit(docs)
    found = langid.predict(odd, model, keep=("text",)).collect()
    for r in found:
        if not r.text or not r.text.strip():
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in model.langs
    assert langid.predict(none, model).count() == 0
    nothing = langid.fit(none)
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert {r.lang_pred for r in langid.predict(spark.createDataFrame([(1, "12 ²³ !?")], "doc_id bigint, text string"), model).collect()} == {"und"}


# --- 10: fingerprints -----------------------------------------------------------------------


def brute_phrases(data: bytes) -> set[bytes]:
    seen, start = set(), 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in seen:
            seen.add(data[start:end])
            start = end
    return seen


def test_phrases_are_the_parse():
    draw = random.Random(14)
    for _ in range(300):
        data = bytes(draw.choices(b"abc", k=draw.randint(0, 60)))
        steps: dict[int, int] = {}
        lz.parse(data, steps)
        words = {0: b""}
        for key, number in steps.items():
            words[number] = words[key & ~255] + bytes([key & 255])
        assert set(words.values()) - {b""} == brute_phrases(data)
    a, b = "the cat sat on the mat " * 20, "the cat sat on the mat " * 19 + "zzz"
    x, y = (np.array([int(f[i : i + 8], 16) for i in range(0, len(f), 8)]) for f in map(lz.fingerprint, (a, b)))
    assert len(x) and sorted(x) == list(x) and len(set(x) & set(y)) > 0.5 * len(x)


def test_likeness_is_the_sets_for_small_ones():
    draw = random.Random(15)
    for _ in range(200):
        a, b = (bytes(draw.choices(b"ab", k=draw.randint(0, 25))) for _ in range(2))
        sets = []
        for data in (a, b):
            steps: dict[int, int] = {}
            lz.parse(data, steps)
            sets.append(np.fromiter(steps, np.int64, len(steps)))
        s = lz.sketches(sets)
        x, y = brute_phrases(a), brute_phrases(b)
        assert lz.likeness(s[:1], s[1:])[0] == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)


def brute_fingerprint(text):
    """From the phrases themselves: each one's hash from that of its prefix, as 64-bit integers."""
    full = (1 << 64) - 1

    def mixed(x):
        x = (x ^ x >> 31) * 0x7FB5D329728EA185 & full
        return (x ^ x >> 27) * 0x81DADEF4BC2DD44D & full

    hashes = {}
    for phrase in sorted(brute_phrases(text.encode()), key=len):
        last = phrase[-1] + 1
        hashes[phrase] = mixed((hashes[phrase[:-1]] * 257 + last if len(phrase) > 1 else last) & full)
    return "".join(f"{h:08x}" for h in sorted({h >> 32 for h in hashes.values()})[:64])


def brute_likeness(a, b):
    x, y = ({f[i : i + 8] for i in range(0, len(f), 8)} for f in (a, b))
    least = sorted(x | y)[:64]
    return sum(h in x and h in y for h in least) / len(least) if least else 1.0


def test_fingerprint_column(spark, odd):
    out = lz.fingerprint_frame(odd.withColumn("id", F.lit(1)))
    assert out.columns == [*odd.columns, "id", "fingerprint"]
    assert rows(out.select("text", "fingerprint")) == Counter((r[1], lz.fingerprint(r[1])) for r in ODD)
    with pytest.raises(ValueError):
        lz.fingerprint_frame(out)


def test_neighbours_in_order(spark, docs, odd, none):
    for df in (docs, odd):
        key = lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode())
        items = sorted(((r.doc_id, r.text) for r in df.collect()), key=key)
        want = Counter()
        for k, (i, text) in enumerate(items):
            text, after = text or "", items[(k + 1) % len(items)][1] or ""
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            a, b, c = map(brute_fingerprint, (text, edited, after))
            want[(i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, brute_likeness(a, b), brute_likeness(a, c))] += 1
        out = lz.compare_neighbours(df, most=100_000)
        assert rows(out) == want
    assert lz.compare_neighbours(none).count() == 0
    one = lz.compare_neighbours(docs.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


# --- the pipeline ---------------------------------------------------------------------------


def test_pipeline_stages(spark, docs, reference):
    """Each stage against what its operator decides by brute force."""
    at, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, SMALL)
        out = out.persist()
        kept[name] = out
        assert name == "byte_pairs" or out.columns == docs.columns
        at = out
    lang, near, private, mixed, coded = (kept[n].collect() for n, _ in corpus_pipeline.STAGES)
    assert len(lang) >= 0.98 * docs.count()
    groups = brute_groups([(r.doc_id, r.text) for r in lang], 5, 80)
    assert {r.doc_id for r in near} == {c for _, n, c in groups if n} | {i for i, n, _ in groups if not n}
    assert {r.doc_id: r.text for r in private} == {r.doc_id: pii.redact(r.text, ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(r.text))) for r in near}
    assert all(r.n_chars == len(r.text) for r in private)
    times = {r.__row.doc_id if hasattr(r, "__row") else r["__row"].doc_id: r.times for r in mixing.plan(kept["personal_data"], mixing.words(F.col("text"))).collect()}
    assert Counter(r.doc_id for r in mixed) == Counter({i: n for i, n in times.items() if n})
    assert [r.n_tokens for r in coded] == [len(r.token_ids) for r in coded]
    texts = {r.doc_id: r.text for r in mixed}
    assert all(r.token_ids == reference.encode_ordinary(texts[r.doc_id]) for r in coded)


def test_pipeline_odd_and_empty_tables(spark, odd, none):
    for df in (none, odd.withColumn("rejected", F.lit("x")).withColumn("spans", F.lit(1))):
        at = df
        for _, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, SMALL).persist()
            at.count()


@pytest.fixture(scope="module")
def small(spark, docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def test_query_1(spark, small, reference):
    want = Counter()
    for i, text in small.items():
        ids = reference.encode_ordinary(text)
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert rows(queries.op1_bpe(spark, SMALL).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) == want


def test_query_3(spark, small):
    assert rows(queries.op3_ngram_join(spark, SMALL).select("doc_id", "n_shingles", "component_id")) == brute_groups(list(small.items()))


def test_query_4(spark):
    want, talks = {}, table(spark, SMALL, "conversations").orderBy("conv_id", "turn").collect()
    odd = [(-1, r, "</s>[INST] ok [/INST]") for r in ("user", "assistant")]
    for c, r, x in [(t.conv_id, t.role, t.text) for t in talks] + odd:
        want.setdefault(c, []).append((r or "", x or ""))
    out = {r.conv_id: r for r in queries.op4_chat(spark, SMALL).collect()}
    assert out.keys() == want.keys()
    for c, turns in want.items():
        learned = "".join(x for r, x in turns if r == "assistant")
        assert (out[c].n_turns, out[c].turns_sha256, out[c].loss_chars, out[c].loss_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
        marks = out[c].formatted_chars - sum(len(r) + len(chat.escape(x)) for r, x in turns)
        assert marks > 0 and marks % len(turns) == 0


def test_query_5(spark):
    items = [(r.vec_id, r.embedding) for r in table(spark, SMALL, "embeddings").collect()]
    want, got = brute_nearest(items, {i for i, _ in items if i is not None and i % 20 == 0}, 20), {}
    for r in queries.op5_ann(spark, SMALL).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got.keys() == want.keys()
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.97 * sum(map(len, want.values()))
    assert all(dict(want[q]).get(i, s) == pytest.approx(s, abs=1e-12) for q in got for i, s in got[q])


def test_query_6(spark, small):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((i, len(text.encode()), len(model.encode(text)), len(model.encode(text)) > 4096) for i, text in small.items())
    assert rows(queries.op6_token_counts(spark, SMALL).select("doc_id", "n_bytes", "n_tokens", "over_limit")) == want


def test_query_8(spark, small):
    extra = {}
    for (row, kind, a, b), _ in brute_bootstrap(sorted(set(small.values()))).items():
        extra.setdefault(row, []).append((kind, a, b))
    want = Counter()
    for i, text in small.items():
        spans = brute_spans(text)
        joined = lambda x: ",".join(f"{k}:{a}:{b}" for k, a, b in x)
        more = sorted(extra.get(hashlib.sha256(text.encode()).hexdigest()[:32], ()))
        want[(i, *(sum(s[0] == k for s in spans) for k in FORMS), hashlib.sha256(joined(spans).encode()).hexdigest(), joined([*spans, *more]))] += 1
    assert rows(queries.op8_pii(spark, SMALL).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")) == want


def test_query_10(spark, small):
    items, want = sorted(small.items(), reverse=True), Counter()
    for k, (i, text) in enumerate(items):
        after = items[(k + 1) % len(items)][1]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        a, b, c = map(brute_fingerprint, (text, edited, after))
        want[(i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, brute_likeness(a, b), brute_likeness(a, c))] += 1
    assert rows(queries.op10_fingerprints(spark, SMALL).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")) == want


def test_queries_are_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11)) and T.StructType is not None
