"""The corpus operators against brute force, on small tables with nulls, ties, repeats, empty and long texts."""

import base64
import hashlib
import random
import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from rivulet.llm import (
    byte_bpe,
    chat_format,
    decontaminate,
    exact_dedup,
    jaccard_join,
    language_id,
    queries,
    suffix_dedup,
    token_counts,
    token_output,
    url_filter,
)

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, id long, h string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = prose(70)
    base = prose(200)
    texts = [None, "", "a", "a", " ", "x" * 700, base, base, prose(60) + " " + shared + " " + prose(30), prose(10) + shared[:300] + prose(90)]
    words = base.split()
    for k in range(12):
        changed = list(words)
        changed[rng.randrange(len(changed))] = "other%d" % k
        texts.append(" ".join(changed))
    texts += [prose(rng.randint(1, 120)) for _ in range(20)] + [prose(9000), "é" * 500, "two\nlines  and\ttabs "]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, 1, "clash") for i, t in zip(ids, texts)] + [(None, base, 2, "clash"), (3, "again", 3, None), (3, "again", 3, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), [(r[0], r[1]) for r in rows]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def brute_substrings(pairs, length=100):
    order = sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, (p[1] or "").encode()))
    seen, out = set(), []
    for i, t in order:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            s = data[k : k + length]
            if s in seen:
                gone[k : k + length] = True
            seen.add(s)
        edge = np.diff(np.concatenate([[0], gone.astype(int)]))
        rest = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(
    "options",
    [{}, {"block_bytes": 3000}, {"block_bytes": 3000, "hash_bits": 2}, {"block_bytes": 3000, "hot": 1}, {"block_bytes": 3000, "hot": 0, "hash_bits": 1, "passes": 1}],
    ids=str,
)
def test_suffix_dedup(spark, docs, options):
    """Whatever the hashes are worth and whichever anchors count as hot, the result is that of the bytes."""
    df, pairs = docs
    got = suffix_dedup.dedup_substrings(df, **options)
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_substrings(pairs)
    for r in got.select("kept", "kept_sha256").collect():
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]


@pytest.mark.parametrize("letters", [1, 2, 4])
def test_suffix_sort_against_bytes(letters):
    """Runs that begin anywhere in a few texts: ties beyond V bytes go by cover ranks whatever the residues are."""
    rng = np.random.default_rng(letters)
    texts = [rng.integers(97, 97 + letters, 400).astype(np.uint8) for _ in range(3)]
    texts[1][50:300] = texts[0][113:363]
    texts[2][7:207] = texts[0][120:320]
    texts[2][207:307] = texts[2][30:130]
    parts, size = [], []
    for _ in range(120):
        t, n = texts[rng.integers(3)], int(rng.integers(1, suffix_dedup.WINDOW + 1))
        a = int(rng.integers(0, len(t) - n - suffix_dedup.LENGTH + 2))
        parts.append(t[a : a + n + suffix_dedup.LENGTH - 1])
        size.append(n)
    size = np.array(size)
    length = np.array([len(p) for p in parts])
    first = np.cumsum(length) - length
    text = np.concatenate(parts)
    seen, want = set(), []
    for f, n in zip(first.tolist(), size.tolist()):
        for k in range(f, f + n):
            s = text[k : k + suffix_dedup.LENGTH].tobytes()
            want.append(s in seen)
            seen.add(s)
    assert suffix_dedup.repeats(text, first, size).tolist() == want


def test_repeats_within_one_run_of_suffixes(spark):
    texts = [("%d" % p + "abcdefghijklmnopqrstuvwxyz"[:p]) * (130 // p) + "tail %d" % p for p in range(1, 27)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = suffix_dedup.dedup_substrings(df)
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_substrings(list(enumerate(texts)))


def test_suffix_dedup_spreads_rows_of_one_id(spark):
    df = spark.createDataFrame([(None, "%03d " % k * 40) for k in range(400)], "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = suffix_dedup._blocks(df, "doc_id", "text", 1 << 20)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert blocks.select((blocks.block / 2**32).cast("long")).distinct().count() > 1
    assert suffix_dedup.dedup_substrings(df).groupBy().sum("n_removed").first()[0] == 400 * 156


def test_suffix_dedup_on_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    pairs = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = queries.op1_suffix_dedup(spark, SF)
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_substrings(pairs)


def test_suffix_dedup_empty(spark):
    assert suffix_dedup.dedup_substrings(empty(spark)).count() == 0


def test_cover_is_perfect():
    d = suffix_dedup.COVER
    assert sorted((a - b) % suffix_dedup.V for a in d for b in d if a != b) == list(range(1, suffix_dedup.V))


def brute_classes(pairs):
    def words(t):
        w = (t or "").split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    groups = defaultdict(list)
    for i, t in pairs:
        groups[words(t)].append(i)
    keys = list(groups)
    links = {k: [] for k in keys}
    for a in range(len(keys)):
        for b in range(a):
            both, all_ = len(keys[a] & keys[b]), len(keys[a] | keys[b])
            if all_ and both >= 0.8 * all_ and keys[a] and keys[b]:
                links[keys[a]].append(keys[b])
                links[keys[b]].append(keys[a])
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    out, done = [], set()
    for k in keys:
        if k in done:
            continue
        part, todo = {k}, [k]
        while todo:
            for n in links[todo.pop()]:
                if n not in part:
                    part.add(n)
                    todo.append(n)
        done |= part
        top = least(i for p in part for i in groups[p])
        out += [(i, top, len(links[p]), least(groups[p]), len(groups[p])) for p in part for i in groups[p]]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [512, 4])
def test_jaccard_join(spark, docs, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    df, pairs = docs
    got = jaccard_join.jaccard_classes(df)
    assert rows(got, "doc_id", "class_id", "n_links", "copy_id", "n_copies") == brute_classes(pairs)
    assert jaccard_join.jaccard_classes(empty(spark)).count() == 0


def test_jaccard_join_on_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    pairs = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert rows(queries.op2_jaccard_join(spark, SF), "doc_id", "class_id", "n_links", "copy_id", "n_copies") == brute_classes(pairs)


def test_pruning_keeps_pairs_at_the_threshold():
    least = jaccard_join.least_matches()
    rng = np.random.default_rng(1)
    lost = sum(any(rng.binomial(n, 0.8) < m for n, m in least.items()) for _ in range(20_000))
    assert lost == 0 and least[jaccard_join.HASHES] > 40


def test_bands_miss_few_pairs_at_the_threshold():
    assert (1 - jaccard_join.THRESHOLD**jaccard_join.ROWS) ** jaccard_join.BANDS < 1e-6
    assert jaccard_join.HASHES % jaccard_join.STEP == 0  # pruning compares whole steps


def test_token_output(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    df, pairs = docs
    extra = [(1000, "Don't 's I'LL!'s"), (1001, "<|endoftext|> x <|startoftext|>."), (1002, "İstanbul ΣΑΣ straße x̧"), (1003, "日本語 😀 12 3"), (1004, "a.b, c ... À.")]
    df, pairs = df.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string")), pairs + extra
    path = public_tokenizers.path("word_bpe_49k.json")
    token_output.write_tokens(df, str(tmp_path / "t"), path, 2)
    got = [tuple(r) for r in token_output.read_digests(spark, str(tmp_path / "t")).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    tk = Tokenizer.from_file(path)
    start, want = 0, []
    for i, t in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0)):
        ids = tk.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    token_output.write_tokens(empty(spark), str(tmp_path / "e"), path, 2)
    assert token_output.read_digests(spark, str(tmp_path / "e")).count() == 0


def test_token_output_file_format(spark, tmp_path):
    import pyarrow.parquet as pq

    token_output.write_tokens(spark.read.parquet(f"{SF}/documents.parquet"), str(tmp_path / "t"), public_tokenizers.path("word_bpe_49k.json"), 2)
    part = next((tmp_path / "t").glob("part-*.parquet"))
    group = pq.ParquetFile(part).metadata.row_group(0)
    ids = next(group.column(k) for k in range(group.num_columns) if group.column(k).path_in_schema.startswith("ids"))
    assert any("DICTIONARY" in e for e in ids.encodings) and ids.has_column_index and ids.has_offset_index


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("hot_rows", [1, 20_000])
def test_exact_dedup(spark, docs, keep, hot_rows):
    df, pairs = docs
    groups = defaultdict(list)
    for i, t in pairs:
        groups[t or ""].append(i)
    pick = max if keep == "largest" else min
    best = {t: pick([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    got = exact_dedup.exact_groups(df, keep=keep, hot_rows=hot_rows).collect()
    want = sorted(((i, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in pairs), key=repr)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == want
    assert sum(r["kept"] for r in got) == len(groups)
    kept = exact_dedup.exact_dedup(df, keep=keep, hot_rows=hot_rows)
    assert kept.columns == df.columns and kept.count() == len(groups)
    assert {(r["doc_id"], r["text"] or "") for r in kept.collect()} == {(i, t) for t, i in best.items()}
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup_splits_copies_whatever_their_ids(spark, keep):
    """Copies with one id, null or not, are dealt over many runs, and one of them stays."""
    copies = spark.range(50_000).select(F.when(F.col("id") % 2 == 0, 7).alias("doc_id"), F.lit("copy").alias("text")).repartition(4)
    df = copies.unionByName(spark.createDataFrame([(1, "other"), (None, "z" * 2000)], "doc_id long, text string"))
    got = exact_dedup.exact_groups(df, keep=keep)
    assert {tuple(r) for r in got.select("keep_id", "group_size").distinct().collect()} == {(7, 50_000), (1, 1), (None, 1)}
    assert sorted((tuple(r) for r in got.where("kept").select("doc_id", "group_size").collect()), key=repr) == [(1, 1), (7, 50_000), (None, 1)]
    assert exact_dedup.exact_dedup(df, keep=keep).count() == 3


def test_exact_dedup_splits_copies_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_BYTES", 100_000)
    df = spark.createDataFrame([(k, "long " * 10_000) for k in range(9)] + [(9, "short")], "doc_id long, text string")
    got = exact_dedup.exact_groups(df)
    assert rows(got.where("kept"), "doc_id", "group_size") == [(8, 9), (9, 1)]
    assert exact_dedup.exact_dedup(df).select(F.sum(F.length("text"))).first()[0] == 50_005


def test_token_counts(spark, docs):
    import sentencepiece

    df, pairs = docs
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted(((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 100) for i, t in pairs), key=repr)
    for chunk, overlap in ((200, 16), (token_counts.CHUNK, token_counts.OVERLAP)):
        got = token_counts.token_counts(df, path, 100, chunk=chunk, overlap=overlap)
        assert rows(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.token_counts(empty(spark), path, 100).count() == 0


def test_resynchronisation_on_hard_texts():
    path = public_tokenizers.path("piece_bpe_32k.model")
    whole, small = token_counts.TokenCounter(path, chunk=1 << 30), token_counts.TokenCounter(path, chunk=100, overlap=8)
    texts = ["a" * 3000 + " b" + "c d " * 300, " " * 500 + "x y " * 200, "日本" * 500, "a\n\n b\tc " * 200, "x" * 150 + "   y" * 100, "È ç" * 200, "x\u200b y" * 200]
    assert whole.proven and whole.counts(texts) == small.counts(texts)


def test_byte_bpe(spark, docs):
    import tiktoken

    df, pairs = docs
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    extra = ["  a  b ", "x\n y", "a'll don't 's", "ab" * 300 + "é" * 200, "日本語 テキスト。", "😀😀 x", "a\tb c", "\n\n", "a\u00a0b \u2003 c", "<|endoftext|> x"]
    df = df.select("doc_id", "text").union(spark.createDataFrame([(2000 + k, t) for k, t in enumerate(extra)], "doc_id long, text string"))
    pairs = pairs + [(2000 + k, t) for k, t in enumerate(extra)]
    want = []
    for i, t in pairs:
        ids = lib.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = byte_bpe.digests(df, path, public_tokenizers.PATTERN)
    assert rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    full = byte_bpe.encode_decode(df, path, public_tokenizers.PATTERN).collect()
    assert sorted(((r["doc_id"], bytes(r["decoded"])) for r in full), key=repr) == sorted(((i, (t or "").encode()) for i, t in pairs), key=repr)
    assert byte_bpe.digests(empty(spark), path, public_tokenizers.PATTERN).count() == 0


def brute_chat(turns):
    by = defaultdict(list)
    for c, n, role, text in turns:
        by[c].append((n is not None, n or 0, role or "", text or ""))
    out = []
    for c, rows_ in by.items():
        rows_.sort()
        lines = "".join(f"{r}\n{t}\n" for _, _, r, t in rows_)
        loss = "".join(t for _, _, r, t in rows_ if r == "assistant")
        out.append((c, len(rows_), hashlib.sha256(lines.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_chat_format(spark):
    rng = random.Random(3)
    turns = [(1, 0, "system", "be < # \\ good"), (2, None, None, None), (None, 1, "user", "x"), (2, 1, "assistant", "\\\\l\\h\\c: ### </turn>\n")]
    for k in range(1, 60):
        text = "".join(rng.choice("ab <#\\\n:é") for _ in range(rng.choice([0, 5, 300, 2000])))
        turns.append((1, k, "assistant" if k % 2 else "user", text))
    turns += [(3, 1, "user", "same"), (3, 1, "user", "same"), (3, 1, "we: ird", ": x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = queries.chat_digests(df)
    assert rows(got, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == brute_chat(turns)
    windows = chat_format.format_windows(df).where("conv_id = 1").orderBy("window").collect()
    assert len(windows) > 3 and all(w["text"].startswith("### system: be \\l \\h \\\\ good</turn>\n") for w in windows)
    assert any(w["first_new"] > 1 for w in windows)
    for w in windows:
        for s in w["loss"]:
            assert w["text"][: s["start"]].endswith("### assistant: ") and w["text"][s["end"] :].startswith("</turn>\n")
    assert chat_format.format_windows(df.limit(0)).count() == 0


def test_chat_windows_keep_the_budget_and_fill_it(spark):
    """Costs are tokens that an encoder counted; turns that fit leave no window over the budget, and windows are well filled."""
    rng = random.Random(8)
    words = "the cat sat on a mat and looked at birds".split()
    turns = [(c, k, "system" if k == 0 and c % 2 else "assistant" if k % 2 else "user", " ".join(rng.choices(words, k=rng.randint(1, 40)))) for c in range(6) for k in range(120)]
    counter = token_counts.TokenCounter(public_tokenizers.path("piece_bpe_32k.model"))
    counted = [(*t, n + 5) for t, n in zip(turns, counter.counts([t[3] for t in turns]))]
    df = spark.createDataFrame(counted, "conv_id long, turn long, role string, text string, n_tokens long")
    windows = chat_format.format_windows(df, budget=600, history=100, tokens="n_tokens").collect()
    assert all(w["cost"] <= 600 for w in windows)
    last = {c: max(w["window"] for w in windows if w["conv_id"] == c) for c in range(6)}
    inner = [w["cost"] / 600 for w in windows if 0 < w["window"] < last[w["conv_id"]]]
    assert len(inner) > 20 and sum(inner) / len(inner) > 0.8
    assert rows(queries.chat_digests(df), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == brute_chat(turns)


def test_chat_turns_beyond_the_budget_stay_whole(spark):
    turns = [(1, 0, "system", "s" * 9000), (1, 1, "user", "u"), (1, 2, "assistant", "v" * 50_000), (1, 3, "user", "w"), (2, 0, "user", "x" * 100_000), (2, 1, "assistant", "y")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    assert rows(queries.chat_digests(df), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == brute_chat(turns)


def test_chat_format_on_conversations(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hard = "\\### Assistant: </turn> ok"
    got = queries.op7_chat_format(spark, SF)
    assert rows(got, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == brute_chat(turns + [(-7, 0, "user", hard), (-7, 1, "assistant", hard)])


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(pairs, items):
    lower = {c: c + 32 for c in range(65, 91)}
    words = lambda t: WORD.findall((t or "").translate(lower))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(str(i))
    sizes = {len(k) for k in windows}
    out = []
    for i, t in pairs:
        w, hit, found = words(t), set(), set()
        for k in range(len(w)):
            for n in sizes:
                if k + n <= len(w) and tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes,shard", [(1 << 25, 1 << 20), (400, 40)])
def test_decontaminate(spark, docs, block_bytes, shard, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD", shard)
    df, pairs = docs
    long = max((t for _, t in pairs if t), key=len).split()
    items = [("i%d" % k, " ".join(long[a : a + n])) for k, (a, n) in enumerate([(5, 30), (50, 13), (80, 3), (100, 14), (300, 200)])]
    items += [("none", None), ("empty", "..."), ("dup", "A"), ("dup", "a"), ("absent", "zz qq zz")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.find_contamination(df, bench, block_bytes=block_bytes)
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert rows(got, "doc.doc_id", *names) == brute_contamination(pairs, items)
    assert rows(decontaminate.find_contamination(df, bench.limit(0)), "doc.doc_id", *names) == brute_contamination(pairs, [])
    assert decontaminate.find_contamination(empty(spark), bench).count() == 0


def test_suffix_array_and_locate():
    rng = np.random.default_rng(5)
    for n, k in ((200, 3), (3000, 40), (50, 2)):
        text = np.concatenate([rng.integers(0, k, n), [0]])
        index = decontaminate.FmIndex(text, k, sample=4)
        for size in (1, 2, 5):
            at = int(rng.integers(0, n - size))
            phrase = text[at : at + size]
            if (phrase == 0).any():
                continue
            want = [p for p in range(len(text) - size + 1) if (text[p : p + size] == phrase).all()]
            low, high = index.search(phrase[None, :], np.array([size]))
            assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


def test_url_rules(spark):
    urls = [
        ("http://WWW.Example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://m.example.com/en/1?x", "m.example.com", "/en/1", "example.com/en/", "block"),
        ("https://badexample.com/en/", "badexample.com", "/en/", "com/", "allow"),
        ("https://a.net/es/x#y", "a.net", "/es/x", "net/es/", "block"),
        ("https://a.net/de/x", "a.net", "/de/x", None, None),
        ("http://x.com", "x.com", "", None, None),
        ("http://x.com?q=/a", "x.com", "", None, None),
        ("no scheme", "", "", None, None),
        ("", "", "", None, None),
        (None, "", "", None, None),
        ("a://b://c/d", "b:", "//c/d", None, None),
        ("http://é.net/fr/\n", "é.net", "/fr/\n", "net/fr/", "block"),
    ]
    df = spark.createDataFrame([(k, u[0], "x") for k, u in enumerate(urls)], "page_id long, url string, score string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(df, queries.URL_RULES).select("page.page_id", "host", "path", "rule", "verdict").collect()}
    assert len(got) == len(urls)
    for k, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule)
        assert got[k]["verdict"] == verdict if verdict else got[k]["verdict"] in ("allow", "block")
    assert url_filter.filter_urls(df.limit(0), queries.URL_RULES).count() == 0


def brute_models(labelled, entries=url_filter.ENTRIES):
    """Log ratios of the interpolated models, counted directly."""
    order = url_filter.ORDER
    fold = lambda u: "\u0100" * order + u.encode().decode("latin-1")
    counts = [defaultdict(int), defaultdict(int)]
    for u, good in labelled:
        s = fold(u)
        for k in range(order, len(s)):
            for n in range(order + 1):
                counts[good][s[k - n : k + 1]] += 1
    totals = [sum(n for g, n in c.items() if len(g) == 1) for c in counts]
    kept = {g for g in {*counts[0], *counts[1]} if (counts[0].get(g, 0) + counts[1].get(g, 0)) * entries >= sum(totals)}
    after = [defaultdict(list), defaultdict(list)]
    for good in (0, 1):
        for g, n in counts[good].items():
            if g in kept:
                after[good][g[:-1]].append(n)

    def probability(c, ctx, good):
        if not ctx:
            return (counts[good].get(c, 0) + 1) / (totals[good] + url_filter.SYMBOLS)
        lower, next_ones = probability(c, ctx[1:], good), after[good].get(ctx, [])
        own = counts[good].get(ctx + c, 0) if ctx + c in kept else 0
        return (own + len(next_ones) * lower) / (sum(next_ones) + len(next_ones)) if next_ones else lower

    def score(u):
        s = fold(u)
        return sum(np.log(probability(s[k], s[k - order : k], 1) / probability(s[k], s[k - order : k], 0)) for k in range(order, len(s))) / (len(s) - order)

    score.kept = kept
    return score


def test_url_scores(spark):
    labelled = [("http://ab.com/a", 1), ("http://ab.com/ab", 1), ("http://zz.net/es/z", 0), ("http://zy.net/es/é", 0)]
    urls = ["http://ab.com/b", "http://zz.net/es/q", "é", "~~"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = url_filter.url_scores(df, spark.createDataFrame(labelled, "url string, good long"))
    score = brute_models(labelled)
    for r in got.collect():
        assert r["score"] == pytest.approx(score(r["url"]))
    assert got.count() == len(urls)


def test_url_scores_by_kept_contexts(spark):
    """Contexts are longer where the labelled URLs bear them."""
    labelled = [(f"http://ab{k}.com/é/{k * k}", 1) for k in range(30)] + [(f"https://zz.net/{k}/ü?{k * 7}", 0) for k in range(30)]
    urls = ["http://ab77.com/é/1", "https://zz.net/q", "日本://x", "/" * 5000]
    score = brute_models(labelled, 60)
    assert len({len(g) for g in score.kept}) == url_filter.ORDER + 1 and len(score.kept) < len(brute_models(labelled).kept) / 4
    got = url_filter.url_scores(spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame(labelled, "url string, good long"), 60)
    got = {r["url"]: r["score"] for r in got.collect()}
    assert got == {u: pytest.approx(score(u)) for u in urls}


def test_url_scores_keep_rare_grams(spark):
    """N-grams rarer than one in ``ENTRIES`` count, whether their windows are broadcast or shuffled."""
    labelled = [("http://aa.com/" + "ab" * 40_000, 1), ("http://zz.net/es/qwvü", 0), ("http://cc.com/xyz", 1)]
    urls = ["http://b.org/qwv", "qwvü", "xyz", "http://cc.co/xyz", "http://b.org/" + "ab" * 3000 + "qwv" * 5, "日本"]
    score = brute_models(labelled, 10**9)
    assert len(score.kept) > len(brute_models(labelled).kept) + 50
    df, train = spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame(labelled, "url string, good long")
    got = {r["url"]: r["score"] for r in url_filter.url_scores(df, train).collect()}
    assert got == {u: pytest.approx(score(u)) for u in urls}
    for hot in (40, 0):
        assert got == {r["url"]: r["score"] for r in url_filter.url_scores(df, train, hot=hot).collect()}


def brute_verdicts(pages):
    """Threshold and verdicts of whole URLs by counting: rules label, a fifth by crc32 calibrates."""
    labelled, free = {}, set()
    for url in pages:
        if url is not None:
            m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url)
            host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
            fits = [(len(h + p), v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
            if fits:
                labelled[url] = int(max(fits)[1] == "allow")
            elif url:
                free.add(url)
    held = {u: g for u, g in labelled.items() if zlib.crc32(u.encode()) % url_filter.HELD_OUT == 0}
    score = brute_models([(u, g) for u, g in labelled.items() if u not in held])
    steps = sorted({int(np.floor(score(u) * 100)) for u in held})
    rate = lambda x: np.mean([score(u) * 100 >= x for u, g in held.items() if g]) + np.mean([score(u) * 100 < x for u, g in held.items() if not g])
    cut = max(steps, key=lambda x: (rate(x), -x)) / 100
    return {u: "allow" if score(u) >= cut else "block" for u in free}, {u: score(u) for u in free}


def test_url_verdicts_by_brute_force(spark):
    pages = [r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("url").collect()]
    pages += [u.replace(".com", ".co") for u in pages if ".com/" in u and "/en/" not in u][:40]  # like the accepted ones
    pages += [pages[0].replace(".com", ".org")] * 50 + [None, None, "", "http://ex.org/" + "a" * 20_000]
    want, score = brute_verdicts(pages)
    df = spark.createDataFrame([(k, u) for k, u in enumerate(pages)], "page_id long, url string")
    got = url_filter.filter_urls(df, queries.URL_RULES).where("rule is null").select("page.page_id", "url", "verdict", "score").collect()
    assert len(got) == sum(not u or u in want for u in pages)
    for r in got:
        if r["url"] is not None and r["url"]:
            assert r["score"] == pytest.approx(score[r["url"]]) and r["verdict"] == want[r["url"]], r["url"]
    assert len({r["verdict"] for r in got}) == 2


def test_url_filter_with_one_class(spark):
    df = spark.createDataFrame([(k, f"http://a{k}.com/x") for k in range(20)] + [(99, "http://b.org/")], "page_id long, url string")
    assert rows(url_filter.filter_urls(df, queries.URL_RULES).where("page.page_id = 99"), "verdict", "rule") in ([("allow", None)], [("block", None)])


def brute_language(train, texts, size):
    def grams(text):
        text = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower())
        out = defaultdict(int)
        for word in text.split():
            padded = f" {word} "
            for n in (1, 2, 3):
                for k in range(len(padded) - n + 1):
                    if padded[k : k + n].strip():
                        out[padded[k : k + n]] += 1
        return out

    # Ties go by the grams' own order: shorter after longer, spaces first.
    key = lambda g: tuple([0x1FFFFF] * (3 - len(g)) + [0 if c == " " else ord(c) for c in g])
    top = lambda counts: sorted(counts, key=lambda g: (-counts[g], key(g)))[:size]
    profiles = {}
    for lang in sorted({a for a, b in train if a is not None and b is not None}):
        total = defaultdict(int)
        for a, b in train:
            if a == lang and b is not None:
                for g, n in grams(b).items():
                    total[g] += n
        profiles[lang] = {g: k for k, g in enumerate(top(total))}
    out = []
    for t in texts:
        mine = top(grams(t or ""))
        if not mine:
            out.append(("und", 0.0))
            continue
        away = {lang: sum(abs(p[g] - k) if g in p else size for k, g in enumerate(mine)) for lang, p in profiles.items()}
        best = min(away, key=lambda lang: (away[lang], lang))
        out.append((best, 1 - away[best] / (size * len(mine))))
    return out


@pytest.mark.parametrize("size", [20, 400])
def test_language_id_by_brute_force(spark, size):
    """Profiles, ties at their ends, and predictions, from counting n-grams of words one by one; a dirty lang is one like others."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").collect()
    train = [(r["lang"], r["text"]) for r in docs[:150]] + [("", "zyx zyx"), (" EN ", "the cat"), (None, "none"), ("en", None)]
    texts = [r["text"] for r in docs[150:]] + [None, "", "1 2", "zyx", "ab ba ab ba", "é"]
    profiles = language_id.learn_profiles(spark.createDataFrame(train, "lang string, text string"), size=size)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], pytest.approx(r["score"])) for r in language_id.predict_language(df, profiles, size=size).select("doc.doc_id", "lang_pred", "score").collect()}
    assert dict(enumerate(brute_language(train, texts, size))) == got


def test_language_id(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op10_language_id(spark, "/root/testdata/sf0.01").join(df.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").collect()
    assert len(held) > 200 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got.collect())


def test_language_id_profiles(spark, docs):
    df, pairs = docs
    train = [("en", "the cat the"), ("xx", "ÇÇ ç"), (None, "zz"), ("en", None)]
    profiles = language_id.learn_profiles(spark.createDataFrame(train, "lang string, text string"))
    assert list(profiles) == ["en", "xx"]

    def grams(text):
        text = " " + re.sub(r" +", " ", "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower())).strip() + " "
        out = defaultdict(int)
        for k in range(len(text)):
            for n in (1, 2, 3):
                g = text[k : k + n]
                if len(g) == n and g.strip() and " " not in g[1:-1]:
                    out[g] += 1
        return out

    unpack = lambda g: "".join(chr(x) if x else " " for x in ((g >> 42) & 0x1FFFFF, (g >> 21) & 0x1FFFFF, g & 0x1FFFFF) if x != 0x1FFFFF)
    keys, counts = language_id.gram_counts("The cat, the")
    assert {unpack(int(k)): int(n) for k, n in zip(keys, counts)} == grams("the cat the")
    found = language_id.predict_language(df, profiles).select("doc.doc_id", "doc.h", "lang_pred", "score").collect()
    assert len(found) == len(pairs) and all(0 <= r["score"] <= 1 for r in found)
    und = language_id.predict_language(spark.createDataFrame([(None,), ("",), ("12 !",)], "text string"), profiles).collect()
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in und)
    assert language_id.predict_language(empty(spark), {}).count() == 0


def test_language_id_learns_so_many_labels(spark):
    """Of a dirty column the labels with the most text are learned, ties by name; the others' texts go to the nearest of these."""
    train = [(f"l{k:03d}", "ab" * (50 if k in (7, 8) else 3) + chr(97 + k % 26)) for k in range(300)]
    df = spark.createDataFrame(train, "lang string, text string")
    profiles = language_id.learn_profiles(df, languages=2)
    assert list(profiles) == ["l007", "l008"]
    assert list(language_id.learn_profiles(df.where("lang > 'l100'"), languages=3)) != list(profiles)
    assert len(language_id.learn_profiles(df)) == 300
    got = language_id.predict_language(df, profiles)
    assert {r["lang_pred"] for r in got.collect()} <= set(profiles) and got.count() == 300


def test_language_id_long_text_in_slices(monkeypatch):
    text = "Straße und Wege, " * 400
    whole = language_id.gram_counts(text)
    monkeypatch.setattr(language_id, "SLICE", 97)
    sliced = language_id.gram_counts(text)
    assert (whole[0] == sliced[0]).all() and (whole[1] == sliced[1]).all()


def test_token_matrix_merges_like_the_long_path():
    bpe = byte_bpe.ByteBpe.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    strings = [b"antidisestablishment", b"a" * 40, "éèê".encode() * 9, b"x"]
    flat, start, size = bpe.merge(strings)
    for k, s in enumerate(strings):
        assert flat[start[k] : start[k] + size[k]].tolist() == bpe._merge_long(s).tolist()


def test_word_encoder_knows_its_family():
    assert token_output.WordEncoder(public_tokenizers.path("word_bpe_49k.json")).by_word
    other = token_output.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_word
    ids, at = other.encode(pa.array(["a  b", None]))
    assert ids[: at[1]].tolist() == other.tokenizer.encode("a  b", add_special_tokens=False).ids and at[1] == at[2]


def test_byte_bpe_classes_characters_as_the_library_does():
    """All characters on whose class Unicode versions differ, and the common scripts, beside what the pattern looks at."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    bpe = byte_bpe._bpe(path, public_tokenizers.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    shapes = ("x{0}'s", "ab{0}cd", " {0}.", "a {0} {0}b  {0}")
    texts = [f.format(chr(c)) for c in sorted({*range(1, 0x3200), *byte_bpe.strange_characters()}) for f in shapes]
    for k in range(0, len(texts), 20_000):
        ids, at = bpe.encode_batch(pa.array(texts[k : k + 20_000]))
        for j, text in enumerate(texts[k : k + 20_000]):
            assert ids[at[j] : at[j + 1]].tolist() == theirs.encode_ordinary(text), repr(text)


@pytest.mark.parametrize("pattern", [r"\w+|\W", r"\p{L}|[^\p{L}]+", r"\S+"])
def test_byte_bpe_cuts_by_the_pattern_given(pattern):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    theirs = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ["hello world, don't", "  two  spaces 12,3 ", "", "éà x\ty"]
    ids, at = byte_bpe.ByteBpe(ranks, pattern).encode_batch(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [theirs.encode_ordinary(t) for t in texts]


def test_token_output_shortcuts_agree_with_the_library():
    encoder = token_output.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = [f.format(chr(c)) for c in range(1, 0x32000) if not 0xD800 <= c < 0xE000 for f in ("x{0}y", "{0}.", "'s{0}t É{0}É")]
    rng = random.Random(5)
    texts += ["".join(rng.choice("aZé'sS.,! 1İſŉ\u0301\u00a0\u200b日ß") for _ in range(rng.randint(1, 30))) for _ in range(5000)]
    for k in range(0, len(texts), 100_000):
        part = texts[k : k + 100_000]
        ids, at = encoder.encode(pa.array(part))
        for j, e in enumerate(encoder.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
            assert ids[at[j] : at[j + 1]].tolist() == e.ids, repr(part[j])


def test_token_files_can_be_read_in_parts(spark, tmp_path):
    """A range of documents touches few row groups, and metadata are columns of their own with page indexes."""
    import pyarrow.parquet as pq

    path = str(tmp_path / "tokens")
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" ")), 40).alias("text"))
    token_output.write_tokens(df, path, public_tokenizers.path("word_bpe_49k.json"), 2, row_group=100_000, page=10_000)
    files = sorted((tmp_path / "tokens").glob("*.parquet"))
    groups = [pq.ParquetFile(f).metadata.row_group(g) for f in files for g in range(pq.ParquetFile(f).num_row_groups)]
    assert len(groups) > 4
    column = {groups[0].column(c).path_in_schema: c for c in range(groups[0].num_columns)}
    spans = [(g.column(column["doc_id"]).statistics.min, g.column(column["doc_id"]).statistics.max) for g in groups]
    assert sum(lo <= 1010 and hi >= 1000 for lo, hi in spans) <= 2
    assert all(g.column(c).has_offset_index and g.column(c).has_column_index for g in groups for c in range(g.num_columns))
    few = spark.read.parquet(path).where("doc_id between 1000 and 1010").select("doc_id", "n_tokens")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan and "GreaterThanOrEqual(doc_id,1000)" in plan
    assert few.count() == 11
