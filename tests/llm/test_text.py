import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import compared
from pyspark.sql import functions as F

from meshloom.llm import bpe, common, components, language, minhash, mixing, quotes, records, repeats, suffixes, urls
from meshloom.llm.queries import ORACLES, QUERIES

random.seed(11)
WORDS = ["".join(random.choice("abcdeé") for _ in range(random.randint(2, 8))) for _ in range(300)]


def prose(n, rnd=random):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def docs(spark, rows, extra=False):
    """rows of (doc_id, text[, source, lang]); extra columns that clash with the operators' own names."""
    rows = [(*r, *[None, "en"][len(r) - 2 :]) if len(r) < 4 else r for r in rows]
    df = spark.createDataFrame([(r[0], r[1], r[3], r[2], len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(7) for c in ("id", "fp", "key", "n", "size", "u", "component", "h", "row", "node", "spans", "copies", "own_id", "_id", "_kept", "_words", "_size", "a.b")}) if extra else df


ODD = [(900, None), (901, ""), (902, " \t\n "), (903, "one two"), (904, "one two"), (905, "x" * 30_000), (906, "word " * 20_000)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, tables, name):
    assert compared(tables, ORACLES[name], QUERIES[name](spark, "/root/testdata/sf0.001")) is None


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 4), (4, 3), (3, 9), (7, 8), (8, 8), (9, None)], [(0, i) for i in range(1, 60)], [(i, i + 1) for i in range(70)]])
def test_components(spark, edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if b is not None:
            p, q = root(a), root(b)
            up[max(p, q)] = min(p, q)
    got = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted((r.node, r.component) for r in got) == sorted((x, root(x)) for x in list(up))


# -- MinHash ---------------------------------------------------------------------------------------


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_near(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None:
                continue
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    comp = [min(rows[j][0] for j in range(len(rows)) if root(j) == root(i)) if rows[i][0] is not None else None for i in range(len(rows))]
    return [(d, len(s), c, None if d is None else d == c) for (d, _), s, c in zip(rows, sets, comp, strict=True)]


def test_minhash_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)  # groups of many block pairs
    base = [prose(120).split() for _ in range(6)]
    rows = []
    for i in range(110):
        w = list(base[i % 6])
        for _ in range(random.randint(0, 4)):
            w[random.randrange(len(w))] = random.choice(WORDS)
        rows.append((200 - i, " ".join(w).upper() if i % 7 == 0 else "  ".join(w)))
    rows += ODD + [(199, rows[1][1]), (None, rows[0][1])]
    got = [tuple(r) for r in minhash.near_duplicates(docs(spark, rows, extra=True)).collect()]
    assert sorted(got, key=repr) == sorted(brute_near(rows), key=repr)


def test_minhash_of_an_empty_table(spark):
    assert minhash.near_duplicates(docs(spark, [])).collect() == []


# -- URLs --------------------------------------------------------------------------------------------


def test_urls(spark):
    rows = [
        (1, "http://a.example.org/es/x?q#f", ""), (2, "https://EXAMPLE.org/en/12", ""), (3, "http://x.com/fr/", ""), (4, "http://notexample.org/es/1", ""), (5, None, None), (6, "no scheme", ""), (7, "http://q.net/a", '<LINK href="http://d.com/de/1#x" rel="Canonical">'), (8, "http://r.net", "<meta http-equiv=refresh content=\"0; url='/b/c'\">"),
        (9, "http://r.net/b/c", ""), (10, "http://s.net/t", '<link rel="canonical" href="//d.com/de/1">'), (11, "http://s.net/u", '<link rel="canonical" href="t">'), (12, "https://v.net/", '<link rel="canonical" href="http://ok.org/">'), (13, "http://w.net/", '<link rel="canonical" href="https://v.net/"><link rel="canonical" href="http://d.com/de/9">'), (14, "http://com", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit("x")).withColumn("u", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(df).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[3] == ("x.com", "/fr/", "com/fr/", "allow") and got[4] == ("notexample.org", "/es/1", "org/", "allow")
    assert got[5] == got[6] == ("", "", None, "allow") and got[14] == ("com", "", None, "allow")
    assert got[7][2:] == (None, "block") and got[10][3] == got[11][3] == "block"  # through aliases, over two steps
    assert got[8][3] == got[9][3] == "allow"
    assert got[12][3] == got[13][3] == "allow"  # an allowed alias outweighs a blocked one
    assert urls.judged(df.limit(0)).collect() == []


# -- quotations -----------------------------------------------------------------------------------------


def test_quotes(spark):
    rows = [
        (1, 0, "a", "Hello there\nsecond  line"), (1, 1, "b", "> hello THERE\n\nmy answer"), (1, 2, "a", "> > second line\n> my answer\nthanks"), (1, 3, "c", "> Hello there\nlate reply"), (1, 4, "b", ">>>" * 4000 + " deep"), (2, 0, "a", None), (2, 1, "b", ""), (None, 0, "a", "x"), (3, None, "a", "> y"), (4, 5, "a", "again"), (4, 5, "b", "again"), (4, 6, "c", "> again"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1)).withColumn("place", F.lit(2))
    got = {(r.conv_id, r.turn, r.role): r for r in quotes.conversations(df).collect()}
    assert [got[1, k, x].parent_turn for k, x in enumerate("abacb")] == [None, 0, 1, 0, 3]
    assert [got[1, k, x].place for k, x in enumerate("abacb")] == [0, 1, 2, 3, 4]
    assert got[1, 2, "a"].text == "thanks" and (got[1, 2, "a"].n_quoted, got[1, 2, "a"].n_linked) == (2, 2) and got[1, 4, "b"].n_linked == 0
    assert got[None, 0, "a"].place is None and got[3, None, "a"].parent_turn is None and got[2, 0, "a"].text == ""
    assert [got[4, t, r].place for t, r in ((5, "a"), (5, "b"), (6, "c"))] == [0, 1, 2]
    assert quotes.conversations(df.limit(0)).collect() == []


def test_turns_of_any_size_and_passages(spark, tmp_path):
    import duckdb

    rows = [
        (1, t, "a", "same words") for t in (-2, -1, 0, 1, 1 << 44)
    ] + [
        (2, -5, "a", "one long paragraph\nthat was wrapped\n\nanother line"), (2, 3, "b", "> one long\n> paragraph that was wrapped\nyes"), (2, 7, "a", "no\n> other"), (2, 8, "c", ">> one long\n>> paragraph that was wrapped\nhm"), (2, 9, "b", "> hm\n> yes\n> hm"), (2, 10, "b", "> > > nobody wrote this"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.place, r.parent_turn, r.n_quoted, r.n_linked, r.text) for r in quotes.conversations(df).collect()}
    assert [got[1, t][:2] for t in (-2, -1, 0, 1, 1 << 44)] == [(0, None), (1, -2), (2, -1), (3, 0), (4, 1)]
    assert got[2, 3][1:4] == (-5, 2, 2)  # wrapped anew
    assert got[2, 8][1] == 3 and got[2, 8][3] == 2  # by the nested level: the one that quoted it
    assert got[2, 9][1:4] == (8, 3, 3) and got[2, 10][1:4] == (9, 1, 0)
    con = duckdb.connect()
    df.write.parquet(str(tmp_path / "c"))
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    assert compared(con, quotes.SQL, quotes.conversations(df)) is None
    many = spark.createDataFrame([(1, 5, "a", "again")], "conv_id long, turn long, role string, text string").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("k")
    assert sorted(r.place for r in quotes.conversations(many).collect()) == list(range(3000))


def test_reply_order_is_preorder(spark):
    parent = {0: None, 1: 0, 2: 0, 3: 1, 4: 2, 5: 1, 6: None, 7: 6, 8: 5}
    n = spark.createDataFrame([(c, k, p) for c in (1, 2) for k, p in parent.items()], "conv_id long, seq long, parent_seq long")
    got = {(r.conv_id, r.seq): r.place for r in quotes.reply_order(n).collect()}
    order = []

    def visit(x):
        order.append(x)
        for k in sorted(k for k, p in parent.items() if p == x):
            visit(k)

    for k in (0, 6):
        visit(k)
    assert [got[1, k] for k in order] == list(range(9)) == [got[2, k] for k in order]


# -- records ----------------------------------------------------------------------------------------------


def test_records_round_trip(spark):
    from tokenizers import Tokenizer

    rows = [(i, prose(random.randint(0, 60))) for i in range(60, 0, -1)] + ODD + [(5, "twice"), (None, "no id"), (7, "É <|endoftext|> don't\x1cstop")]
    path = common.new_path(spark, "t")
    records.write_records(docs(spark, rows, extra=True).repartition(3), path, files=5)
    tok = Tokenizer.from_file(records.TOKENIZER)
    tok.encode_special_tokens = True
    want = sorted((d is not None, d or 0, tuple(e.ids) + (1,)) for (d, _), e in zip([r[:2] for r in rows], tok.encode_batch([r[1] or "" for r in rows], add_special_tokens=False), strict=True))
    back = records.read_records(spark, path).join(records.positions(spark, path), ["file_no", "at"]).orderBy("file_no", "at").collect()
    assert [r.start for r in back] == np.concatenate([[0], np.cumsum([r.n_tokens for r in back])[:-1]]).tolist()
    assert [(r.doc_id is not None, r.doc_id or 0) for r in back] == [w[:2] for w in want]
    assert sorted((r.doc_id is not None, r.doc_id or 0, tuple(r.ids)) for r in back) == want
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in back)
    dealt = records.shuffled(spark, path, 3, 4).collect()
    assert sorted(tuple(r.ids) for r in dealt) == sorted(w[2] for w in want)
    assert [(r.shard, r.place) for r in dealt] != sorted((r.shard, r.place) for r in records.shuffled(spark, path, 4, 4).collect())
    one = records.shuffled(spark, path, 3, 4, only=2).collect()
    assert [(r.place, r.doc_id, tuple(r.ids)) for r in one] == [(r.place, r.doc_id, tuple(r.ids)) for r in dealt if r.shard == 2] and one
    at = spark.read.parquet(f"{path}/index").where("doc_id = 7")
    assert sorted(tuple(r.ids) for r in records.fetched(spark, path, at).collect()) == sorted(w[2] for w in want if w[1] == 7 and w[0])


def test_records_find_damage():
    data = bytearray(records.frame(3, np.array([1, 70000, 2])) + b"\n")
    assert [(d, i.tolist()) for _, _, d, i in records.frames(bytes(data))] == [(3, [1, 70000, 2])]
    for at in (0, 9, 20, len(data) - 3):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises((ValueError, struct.error)):
            list(records.frames(bytes(bad)))


def test_empty_record_files(spark):
    path = common.new_path(spark, "t")
    records.write_records(docs(spark, []), path, files=2)
    assert records.read_records(spark, path).collect() == [] and records.positions(spark, path).collect() == []


# -- mixing ---------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, goal, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        share = {s: left * w[s] / sum(w[t] for t in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return goal | share
        for s in over:
            goal[s] = 2.0 * sizes[s]
            left -= goal[s]
        free -= over
    return goal


def test_mixing(spark):
    rnd = random.Random(2)
    rows = [(i, prose(rnd.randint(1, 400), rnd), rnd.choice(["a", "b", "é", "Z", None, "a", "a"])) for i in range(700)] + [(900, None, "a"), (901, "", "only blank"), (5, "repeated row", "b"), (5, "repeated row", "b"), (None, "no id", "b")]
    df = docs(spark, rows, extra=True)
    got = mixing.mixed(df).collect()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    goal, taken = brute_targets(size), {}
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(goal[r.source]) and r.taken == r.copies * r["size"] <= 2 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, n in taken.items():
        assert abs(n - goal[s]) <= 800, (s, n, goal[s])
    again = mixing.mixed(df.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert mixing.mixed(df.limit(0)).collect() == []


# -- repeats ---------------------------------------------------------------------------------------------


def brute_repeats(texts, n=400):
    raw, seen = [(t or "").encode() for t in texts], {}
    for i, b in enumerate(raw):
        for p in range(len(b) - n + 1):
            seen.setdefault(b[p : p + n], []).append((i, p))
    covered = [bytearray(len(b)) for b in raw]
    for at in seen.values():
        if len(at) > 1:
            for i, p in at:
                covered[i][p : p + n] = b"\1" * n
    return [(len(b), sum(c), len(re.findall(b"\1+", bytes(c))), hashlib.sha256(bytes(x for x, y in zip(b, c, strict=True) if not y)).hexdigest()) for b, c in zip(raw, covered, strict=True)]


@pytest.mark.parametrize("contents", [2, 256])
def test_repeats_equal_brute_force(spark, monkeypatch, contents):
    monkeypatch.setattr(repeats, "CONTENTS", contents)
    monkeypatch.setattr(repeats, "BLOCK", 3000)
    rnd = random.Random(4)
    common_ = [prose(130, rnd) for _ in range(3)]
    texts = [None, "", "x" * 399, "y" * 401, "ab" * 500, "z" * 7000]
    for _ in range(60):
        t = prose(rnd.randint(5, 120), rnd)
        for _ in range(rnd.randint(0, 2)):
            a = rnd.randint(0, 150)
            t += rnd.choice(common_)[a : a + rnd.randint(380, 600)] + prose(rnd.randint(0, 30), rnd)
        texts.append(t)
    texts.append(prose(900, rnd) + common_[0])
    rows = list(enumerate(texts + texts[10:16])) + [(None, texts[30]), (50, texts[50])]
    got = repeats.without_repeats(docs(spark, rows, extra=True)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    want = [(d, *w) for (d, _), w in zip(rows, brute_repeats([t for _, t in rows]), strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert repeats.without_repeats(docs(spark, [])).collect() == []


def test_suffix_array_with_spilled_queues():
    rnd = random.Random(6)
    for k in range(300):
        t = np.array([rnd.randint(0, rnd.choice([1, 2, 5])) for _ in range(rnd.randint(1, 40))], np.uint16)
        if k % 4 == 0:
            t = np.tile(t[:7], 6)
        text = t.tolist()
        order = sorted(range(len(text)), key=lambda i: text[i:])
        shared = [0] + [next((j for j in range(50) if text[a + j : a + j + 1] != text[b + j : b + j + 1] or a + j >= len(text)), 0) for a, b in zip(order, order[1:], strict=False)]
        sa, lcp = suffixes.suffix_array(t, 100, memory=0 if k % 2 else 1 << 20)
        assert sa.tolist() == order and lcp.tolist() == shared


# -- language -----------------------------------------------------------------------------------------------


def test_marginals_equal_word_by_word():
    rng = np.random.default_rng(1)
    e, a, s, first = rng.random((250, 3)) + 0.05, rng.random((3, 3)) + 0.05, rng.random(3) + 0.05, np.array([0, 1, 33, 97, 250])
    got = language.marginals(e, first, a, s)
    for x, y in zip(first, first[1:], strict=False):
        alpha = [s * e[x]]
        for i in range(x + 1, y):
            alpha.append((alpha[-1] @ a) * e[i] / (alpha[-1] @ a * e[i]).sum())
        beta = [np.ones(3)]
        for i in range(y - 1, x, -1):
            beta.append(a @ (e[i] * beta[-1]) / (a @ (e[i] * beta[-1])).sum())
        g = np.array(alpha) * np.array(beta[::-1])
        assert np.allclose(got[x:y], g / g.sum(axis=1, keepdims=True))


def test_held_out_languages(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identified(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got) and len(got) > 200
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98 and all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_texts(spark):
    rows = [(i, prose(20), "s", "xx" if i % 2 else "yy") for i in range(20)] + [(r[0], r[1], None, None) for r in ODD] + [(950, "12 ! 🙂 —", None, None), (951, "漢字", None, None), (None, "words here", None, "xx")]
    got = {r.doc_id: r for r in language.identified(docs(spark, rows, extra=True)).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (900, 901, 902, 950)) and got[951].lang_pred in ("xx", "yy")
    assert {r.lang_pred for r in language.identified(docs(spark, [(1, "a b", None, None)])).collect()} == {"und"}
    assert language.identified(docs(spark, [])).collect() == []


def test_code_switching():
    m = language.fit(["the of and that with for " * 30, "der und nicht die das ist " * 30], ["en", "de"])
    tags = [t for _, t, _ in language.words_of(m, ["the of and with der und nicht das ist"])[0]]
    assert tags[:4] == ["en"] * 4 and tags[5:] == ["de"] * 4


# -- byte-level BPE ---------------------------------------------------------------------------------------------


def tik():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.RANKS), special_tokens={})


def test_bpe_equals_tiktoken(spark):
    rnd = random.Random(9)
    rows = [(i, "".join(rnd.choice("ab c\n  \t's 't12é漢 　.!?'🙂\x1c\u0301") for _ in range(rnd.randint(0, 60)))) for i in range(800)] + ODD
    enc = tik()
    got = bpe.decoded(bpe.encoded(docs(spark, rows, extra=True))).collect()
    want = {d: t or "" for d, t in [r[:2] for r in rows]}
    for r in got:
        assert list(r.ids) == enc.encode_ordinary(want[r.doc_id]) and bytes(r.raw) == want[r.doc_id].encode() and r.text == want[r.doc_id]
    assert len(got) == len(rows) and bpe.encoded(docs(spark, [])).collect() == []


def test_bpe_offsets_and_split_characters(spark):
    text = "é 漢🙂 ab"
    r = bpe.encoded(docs(spark, [(1, text)]), offsets=True).first()
    raw, piece = text.encode(), tik().decode_single_token_bytes
    assert b"".join(raw[a:b] for a, b in zip(r.byte_start, r.byte_end, strict=True)) == raw
    for i, a, b, c, d in zip(r.ids, r.byte_start, r.byte_end, r.char_start, r.char_end, strict=True):
        assert raw[a:b] == piece(i) and text[c:d].encode().find(raw[a:b]) >= 0
    cut = spark.createDataFrame([(1, r.ids[:2]), (2, None)], "doc_id long, ids array<int>")
    back = {x.doc_id: x for x in bpe.decoded(cut).collect()}
    assert back[2].raw is None and raw.startswith(bytes(back[1].raw))


# -- the pipeline -----------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline as p

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, seen = d.columns, []
    for name, stage in p.STAGES:
        n = d.count()
        out = common.stored(stage(spark, d, "/root/testdata/sf0.001"), "t")
        seen.append((name, n, out.count()))
        if name != "byte_bpe":
            assert out.columns == columns and out.dtypes == d.dtypes
        if name == "minhash_dedup":
            assert sorted(r.doc_id for r in out.collect()) == sorted(x[0] for x in brute_near([(r.doc_id, r.text) for r in d.collect()], 80) if x[3])
        if name == "repeat_removal":
            want = {x.doc_id: x.text for x in d.collect()}
            cut = dict(zip(want, brute_repeats(list(want.values())), strict=True))
            assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in out.collect() if cut[r.doc_id][1] == 0} == {k: c[3] for k, c in cut.items() if c[1] == 0}
        d = out
    assert all(after > 0 for _, _, after in seen) and seen[0][2] == seen[0][1] and seen[1][2] < seen[1][1]


def test_stages_keep_odd_rows_and_columns(spark):
    import corpus_pipeline as p

    rnd = random.Random(8)
    rows = [(i, prose(30, rnd), "ab"[i % 2], "xx" if i % 3 else "yy") for i in range(20)] + [(None, prose(40, rnd), None, None), (None, prose(40, rnd), None, None), (30, None, "a", None), (31, "", "a", "xx"), (32, prose(25, rnd), "a", "xx"), (32, prose(25, rnd), "a", "xx")]
    rows += [(33, rows[5][1], "a", "xx"), (33, rows[5][1], "b", "xx"), (None, rows[6][1], None, "yy"), (5, "12 !", "a", "xx")]  # copies that share an id or have none; an id with a good and a bad text
    d = docs(spark, rows, extra=True)
    for name, stage in p.STAGES:
        out = common.stored(stage(spark, d, ""), "t")
        if name == "byte_bpe":
            assert out.count() == d.count()
            continue
        assert out.columns == d.columns and out.dtypes == d.dtypes
        if name == "language_id":
            assert d.count() - out.count() == 3 and out.where("doc_id = 5").count() == 1  # the texts without a letter
        if name in ("minhash_dedup", "repeat_removal"):
            assert out.where("doc_id IS NULL").count() == 2 and out.where("doc_id = 32").count() == 2  # two unlike texts of one id
        if name == "source_mixing":
            assert out.groupBy("text").count().agg(F.max("count")).first()[0] <= 2
        d = out


def test_words_match_the_pattern():
    texts = ["a  b\tc\x0bd", "", " x", "É\x1cq z ", None]
    raw, ends = common.text_bytes(pa.array(texts, pa.string()))
    _, first = common.word_hashes(raw, ends)
    assert np.diff(first).tolist() == [len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for t in texts]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


WORD_, OTHER = thue_morse(1024), thue_morse(1024).translate(str.maketrans("ab", "ba"))  # collide in any polynomial modulo 2**64


def test_hashes_tell_structured_words_apart():
    raw, ends = common.text_bytes(pa.array([WORD_, OTHER]))
    h = common.Spans(raw).of(ends[:-1], ends[1:])
    p = common.piece_hashes(raw, ends[:-1], ends[1:])
    assert h[0] != h[1] and p[0] != p[1]
    assert common.classes(raw, ends[:-1], ends[1:])[1].tolist() in ([0, 1], [1, 0])


def test_pieces_with_one_hash_are_compared(monkeypatch):
    monkeypatch.setattr(common, "piece_hashes", lambda raw, starts, stops: (stops - starts).astype(np.uint64) % np.uint64(2))
    words = ["a", "b", "a", "cc", "dd", "cc", "x" * 300, "x" * 299 + "y", "x" * 300, "b"]
    raw, ends = common.text_bytes(pa.array(words))
    one, which = common.classes(raw, ends[:-1], ends[1:])
    assert [words[k] for k in one[which]] == words


@pytest.mark.parametrize("texts", [[WORD_, OTHER, WORD_]])
def test_operators_tell_structured_words_apart(spark, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(records.TOKENIZER)
    ids, row = records.WordEncoder(records.TOKENIZER)(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(row, row[1:], strict=False)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    ids, row = bpe.Encoder(bpe.RANKS)(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(row, row[1:], strict=False)] == [tik().encode_ordinary(t) for t in texts]
    rows = list(enumerate(texts))
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs(spark, rows)).collect())
    assert got == [(0, 0), (1, 1), (2, 0)]
    rows = list(enumerate([WORD_ + prose(90), OTHER + prose(90), prose(80) + OTHER]))
    got = repeats.without_repeats(docs(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == [(d, *w) for (d, _), w in zip(rows, brute_repeats([t for _, t in rows]), strict=True)]
