"""Tokenised operators against the tokenizers library, plain arrays and brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from papyrion.llm import elias_fano
from papyrion.llm.bpe import Transducer, bpe_decode, bpe_encode, bpe_round_trip
from papyrion.llm.mixing import entropy, mix_sources, mixed_corpus, rates, solve_exponent, weights
from papyrion.llm.token_counts import length_histogram, document_lengths, quantiles, token_counts, totals_at
from papyrion.llm.token_output import token_output
from papyrion.llm.vocabulary import TokenCounter, WordEncoder

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def texts():
    rng = random.Random(3)
    alphabets = ["abc", "the of  and ", "aeiou rst\n", "!?.,-  ", "0123456789 ", " \t\n\r\x0b\x1c\x85\xa0 ", "éàßçñ ", "日本語テキスト", "😀🎉👍🏽 ", "ABCdef'st're ", "é ́x"]
    out = ["", " ", "  ", "a", "\n\n a", "<|endoftext|>", "x <|endoftext|> y<|endoftext|>", "don't we'll they're 'S", "Éa <|startoftext|> B", "�\x00​", "a" * 3000, "ab" * 900, "=" * 700, " " * 900 + "x", "-" * 64 + "a" * 70, "ΑΣ ΟΔΟΣ"]
    for _ in range(300):
        a = rng.choice(alphabets) + (rng.choice(alphabets) if rng.random() < 0.5 else "")
        out.append("".join(rng.choice(a) for _ in range(rng.randrange(1, 90))))
    for _ in range(6):
        out.append("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2500)))
        out.append("".join(rng.choice("ther ing tion and".replace(" ", "")) for _ in range(2500)))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x", 1) for k, t in enumerate(texts())] + [(None, "no id", None, None), (10**12, None, None, None), (7, "again", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(4), rows


def test_word_pieces_give_the_library_ids():
    whole = Tokenizer.from_file(WORD)
    encoder = WordEncoder(WORD, limit=50)
    for t, code in zip(texts(), encoder.encode(texts()), strict=True):
        assert np.frombuffer(code, encoder.kind).tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_letters_go_to_the_merges_directly():
    whole, encoder = Tokenizer.from_file(WORD), WordEncoder(WORD)
    rng, asked = random.Random(5), []
    letters = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))
    marks = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
    some = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) + "".join(rng.choice(marks) for _ in range(rng.choice([0, 0, 1, 4]))) for _ in range(40)) for _ in range(50)]
    some += ["é\u0301 a\u0338= a=\u0338 ª º÷ x÷ don't'll it's' a'.s a1.b .a ʼn ß ÿ. \xa0a. a.\xa0 a\x1c.b", "İa ΑΣ. Éa. a.<|endoftext|> b"]

    class Watched:
        def __getattr__(self, name):
            return getattr(tokenizer, name)

        def encode_batch_fast(self, given, **options):
            asked.extend(given)
            return tokenizer.encode_batch_fast(given, **options)

    tokenizer, encoder.tokenizer = encoder.tokenizer, Watched()
    for t, code in zip(some, encoder.encode(some), strict=True):
        assert np.frombuffer(code, encoder.kind).tolist() == whole.encode(t, add_special_tokens=False).ids, t
    assert len(asked) < 40  # before, all 2,000 words


def test_counts_match_the_library():
    whole = Tokenizer.from_file(BYTE)
    assert TokenCounter(BYTE, limit=50).count(texts()) == [len(whole.encode(t, add_special_tokens=False).ids) for t in texts()]


def test_new_pieces_are_counted_from_one_text():
    whole, counter, asked = Tokenizer.from_file(BYTE), TokenCounter(BYTE), []

    class Watched:
        def __getattr__(self, name):
            return getattr(counter_tokenizer, name)

        def encode_batch_fast(self, given, **options):
            asked.extend(given)
            return counter_tokenizer.encode_batch_fast(given, **options)

    counter_tokenizer, counter.tokenizer = counter.tokenizer, Watched()
    some = [f"first\n w{k} the{k}x\t é{k} '{k}'s ...{k}" for k in range(50)]
    assert counter.count(some) == [len(whole.encode(t, add_special_tokens=False).ids) for t in some]
    assert len(asked) == 1  # before, a text for each of the 250 pieces
    marked = ["a b<|endoftext|>c d", "a\u2028 <|endoftext|> e"]
    assert counter.count(marked) == [len(whole.encode(t, add_special_tokens=False).ids) for t in marked]


def test_transducer_gives_the_library_ids_and_text():
    whole, own = Tokenizer.from_file(BYTE), Transducer(BYTE, limit=50, step=37)
    for t in texts():
        ids = np.frombuffer(b"".join(own.encode(t, step=5)), "<u4").tolist()
        assert ids == whole.encode(t, add_special_tokens=False).ids, t
        assert "".join(own.decode([np.array([i], "<u4").tobytes() for i in ids])) == whole.decode(ids, skip_special_tokens=False)
    rng = random.Random(9)
    for _ in range(200):  # ids that aren't the encoding of any text
        ids = [rng.randrange(50257) for _ in range(12)]
        assert "".join(own.decode([np.array(ids, "<u4").tobytes()])) == whole.decode(ids, skip_special_tokens=False)


def test_stream_keeps_constant_memory():
    own = Transducer(BYTE)
    rng = random.Random(4)
    data = "".join(rng.choice("aehrstionng") for _ in range(20000)).encode()
    emitted, most, fed = 0, 0, 0

    def parts():
        nonlocal most, fed
        for at in range(0, len(data), 100):
            most = max(most, fed - emitted)
            fed += 100
            yield data[at : at + 100]

    for token in own.stream(parts()):
        emitted += len(own.bytes_of[token])
    assert emitted == len(data) and most <= 4 * own.lookahead


def test_round_trip_query(docs):
    df, rows = docs
    whole = Tokenizer.from_file(BYTE)
    want = []
    for i, t, *_ in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_round_trip(df, BYTE).collect()]
    assert sorted(got) == sorted(want)
    back = bpe_decode(bpe_encode(df, BYTE), BYTE)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(i), t or "") for i, t, *_ in rows)
    assert bpe_round_trip(df.limit(0), BYTE).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(1)
    for values in ([], [0], [0, 0, 0], [5], [2**40, 2**40 + 1], np.sort(rng.integers(0, 10**9, 3000)), np.cumsum(rng.integers(0, 3, 2000)), np.arange(700)):
        values = np.array(values, np.int64)
        reader = elias_fano.Reader(elias_fano.encode(values))
        assert reader.block(0, len(values)).tolist() == values.tolist()
        assert [reader[i] for i in range(len(values))] == values.tolist()
        assert reader.block(len(values) // 3, len(values) // 2).tolist() == values[len(values) // 3 : len(values) // 2].tolist()
    assert len(elias_fano.encode(np.sort(rng.integers(0, 10**7, 10000)))) < 10000 * 13 / 8 + 2000


def test_token_output(spark, docs):
    df, rows = docs
    whole = Tokenizer.from_file(WORD)
    got = token_output(spark, df, WORD).orderBy("start").collect()
    keys = [(-1 if r.doc_id is None else r.doc_id) for r in got]
    assert keys == sorted(keys) and len(got) == len(rows)
    codes = {}
    for i, t, *_ in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        codes.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    at = 0
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in codes[r.doc_id]
        at += r.n_tokens
    assert token_output(spark, df.limit(0), WORD).count() == 0


def test_token_counts(docs):
    df, rows = docs
    whole = Tokenizer.from_file(BYTE)
    lengths = sorted(len(whole.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in rows)
    got = {r.n_tokens: r for r in token_counts(df, BYTE).collect()}
    assert sorted(got) == sorted(set(lengths))
    for n, r in got.items():
        assert r.n_docs == lengths.count(n) and r.docs_to == sum(x <= n for x in lengths) and r.docs_over == sum(x > n for x in lengths)
        assert r.tokens_to == sum(x for x in lengths if x <= n) and r.tokens_from == sum(x for x in lengths if x >= n) and r.docs_from == sum(x >= n for x in lengths)
        assert r.truncated_total == sum(min(x, n) for x in lengths)
    bars = length_histogram(document_lengths(df, BYTE), width=7)
    for r in totals_at(bars, [0, 3, 50, 10**6]).collect():
        assert (r.kept_tokens, r.truncated_docs, r.tokens) == (sum(min(x, r.context_limit) for x in lengths), sum(x > r.context_limit for x in lengths), sum(lengths))
    for r in quantiles(bars, [0.5, 0.9, 1.0]).collect():
        assert r.n_tokens == min(x for x in lengths if sum(y <= x for y in lengths) >= r.share * len(lengths))
    empty = token_counts(df.limit(0), BYTE)
    assert empty.count() == 0 and totals_at(empty, [5]).first().tokens == 0 and quantiles(empty, [0.5]).first().n_tokens is None


def test_exponent():
    tokens = [1000, 500, 20, 0]
    a = solve_exponent(tokens, max_repeats=4)
    w, r = rates(tokens, a, None)
    assert max(r) == pytest.approx(4) and min(r) == pytest.approx(1) and sum(w) == pytest.approx(1)
    b = solve_exponent(tokens, target_entropy=0.9)
    assert entropy(weights([t / 1520 for t in tokens], b)) == pytest.approx(0.9)
    assert solve_exponent([5, 5], max_repeats=2) == 0


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(["word"] * rng.randrange(1, 40)), rng.choice(["big"] * 8 + ["mid"] * 3 + ["small", None]), 5, 6) for k in range(600)]
    rows += [(601, None, "big", 0, 0), (602, "", "empty", 0, 0), (603, "a b", "mid", 0, 0), (603, "a b", "mid", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, __pass int")
    size = {(i, t): len(Tokenizer.from_file(BYTE).encode(t or "").ids) for i, t, *_ in rows}
    tokens = {}
    for i, t, s, *_ in rows:
        tokens[s] = tokens.get(s, 0) + size[i, t]
    options = {"max_repeats": 3.5, "block_tokens": 100}
    got = mix_sources(df, BYTE, **options).collect()
    assert len(got) == len(rows)
    names = list(tokens)
    a = solve_exponent([tokens[s] for s in names], max_repeats=3.5)
    _, r = rates([tokens[s] for s in names], a, None)
    text = {i: t for i, t, *_ in rows}
    blocks = {}
    for x in got:
        blocks.setdefault((x.source, x.block), set()).add(x.copies)
    assert all(len(v) == 1 for v in blocks.values())
    for s, rate in zip(names, r, strict=True):
        mine = [x for x in got if x.source == s]
        used = sum(x.copies * size[x.doc_id, text[x.doc_id]] for x in mine)
        assert all(int(rate + 1e-9) <= x.copies <= int(rate) + 1 for x in mine)
        largest = max(sum(size[x.doc_id, text[x.doc_id]] for x in mine if x.block == b) for b in {x.block for x in mine})
        assert rate * tokens[s] - largest <= used <= rate * tokens[s] + 1e-6
    whole = mixed_corpus(df, BYTE, **options)
    assert whole.columns == df.columns and whole.count() == sum(x.copies for x in got)
    half = mix_sources(df, BYTE, target_entropy=0.5, budget=500.0, block_tokens=50).collect()
    assert 300 < sum(x.copies * size[x.doc_id, text[x.doc_id]] for x in half) <= 500
    assert mix_sources(df.limit(0), BYTE, **options).count() == 0


def test_mixing_realises_the_weights_of_small_sources(spark):
    """With the default parameters, where a source has far fewer tokens than a block may have."""
    rng = random.Random(8)
    rows = [(k, " ".join(["word"] * rng.randrange(5, 40)), s) for k, s in enumerate(["a"] * 4000 + ["b"] * 1500 + ["c"] * 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    encoder = Tokenizer.from_file(BYTE)
    size = {k: len(encoder.encode(t).ids) for k, t, _ in rows}
    tokens = [sum(size[k] for k, _, x in rows if x == s) for s in "abc"]
    for options in ({"max_repeats": 1.99}, {"max_repeats": 3.9}, {"max_repeats": 1.5, "budget": 0.6 * sum(tokens)}):
        got = mix_sources(df, BYTE, **options).collect()
        target, r = rates(tokens, solve_exponent(tokens, **options), options.get("budget"))
        used = [sum(x.copies * size[x.doc_id] for x in got if x.source == s) for s in "abc"]
        for s, t, rate, n in zip("abc", tokens, r, used, strict=True):
            assert 0.98 * rate * t <= n <= rate * t + 1e-6, (s, options)
        assert [n / sum(used) for n in used] == pytest.approx(target, abs=0.01)


def plain_merge(own, data):
    """The merge list applied pair by pair, lowest rank and leftmost first."""
    parts = [own.single[b] for b in data]
    while True:
        ranked = [(own.pairs[p], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in own.pairs]
        if not ranked:
            return parts
        (_, made), at = min(ranked)
        parts[at : at + 2] = [made]


def test_neighbours_follow_the_merge_list():
    own = Transducer(BYTE)
    rng = random.Random(12)
    short = [i for i in own.alone if len(own.bytes_of[i]) < 12]
    for _ in range(20000):
        a, b = rng.choice(short), rng.choice(short)
        assert own._fits(a, b) == (plain_merge(own, own.bytes_of[a] + own.bytes_of[b]) == [a, b])
    for text in ("aaaaaaa", "ababababa", "=========", " the theathe", "lllooollol"):
        for k in range(1, len(text)):
            for a in (text[:k],):
                x, y = own.ids.get(a.encode()), own.ids.get(text[k:].encode())
                if x is not None and y is not None:
                    assert own._fits(x, y) == (plain_merge(own, text.encode()) == [x, y])
    for word in ("a", "zyzzyva", "naïveté", "===-=-==", "日本"):
        assert list(own.word(word)) == plain_merge(own, word.encode())


def test_a_word_of_megabytes_streams_in_constant_memory():
    own = Transducer(BYTE)
    rng = random.Random(13)
    text = "".join(rng.choice("thersainong") for _ in range(2_000_000))
    import tracemalloc

    "".join(own.decode(own.encode(text[:200_000])))  # the bounded tables fill
    tracemalloc.start()
    size = sum(len(part) for part in own.decode(own.encode(text)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size == len(text) and peak < 60_000_000 and len(own.tokens) <= 300_000


def test_elias_fano_reads_slices():
    rng = np.random.default_rng(2)
    for values in (np.cumsum(rng.integers(0, 5000, 3000)), np.array([0, 0, 7, 2**30, 2**30, 2**41]), np.sort(np.concatenate([rng.integers(0, 50, 900), [10**12]]))):
        code = elias_fano.encode(values)
        asked = []

        def read(at, n, code=code, asked=asked):
            asked.append(n)
            return code[at : at + n]

        reader = elias_fano.Reader(read)
        for a, b in ((0, 1), (len(values) // 2, len(values) // 2 + 3), (len(values) - 1, len(values))):
            assert reader.block(a, b).tolist() == values[a:b].tolist()
        assert [reader[i] for i in range(0, len(values), 97)] == values[::97].tolist()
    code = elias_fano.encode(np.cumsum(rng.integers(0, 3000, 100_000)))
    asked.clear()
    assert len(elias_fano.Reader(lambda at, n: asked.append(n) or code[at : at + n]).block(50_000, 50_100)) == 100
    assert sum(asked) < 2000 < len(code)


def test_shards_are_read_by_several_tasks(spark, docs):
    from papyrion.llm.token_output import read_shards, write_shards
    from papyrion.workspace import shared_folder

    df, rows = docs
    manifest = write_shards(df, f"{shared_folder(spark)}/several", WORD)
    parts = read_shards(manifest, block=16, task_bytes=2048)
    assert parts.rdd.getNumPartitions() > 4
    assert sorted(map(tuple, parts.collect()), key=lambda r: r[1]) == sorted(map(tuple, read_shards(manifest).collect()), key=lambda r: r[1])
    with pytest.raises(ValueError):
        WordEncoder(BYTE)


def test_mixed_rows_keep_the_values_of_columns_of_any_name(spark):
    rows = [(k, "word " * (k % 7), "ab"[k % 3 == 0], k, f"b{k}", -k) for k in range(300)] + [(None, None, None, 1, "n", 2), (5000, "very long " * 50_000, "a", 3, "l", 4), (1, "word ", "a", 1, "b1", -1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __pass long, `row.b` string, copies long")
    uses = {}
    for x in mix_sources(df, BYTE, max_repeats=3.0).collect():
        uses.setdefault(x.doc_id, []).append(x.copies)
    got = {}
    for r in mixed_corpus(df, BYTE, max_repeats=3.0).collect():
        got[tuple(r)] = got.get(tuple(r), 0) + 1
    want = {}
    for r in rows:
        if uses[r[0]][0]:
            want[r] = want.get(r, 0) + uses[r[0]][0]
    assert got == want and mixed_corpus(df.limit(0), BYTE, max_repeats=3.0).count() == 0


def test_many_sources_are_weighed_by_their_sizes(spark):
    sizes = [5, 5, 5, 900, 40, 40]
    by_source = weights([t / sum(sizes) for t in sizes], 0.4)
    by_size = weights([t / sum(sizes) for t in (5, 40, 900)], 0.4, [3, 2, 1])
    assert by_size == pytest.approx([by_source[0], by_source[4], by_source[3]]) and entropy(by_size, [3, 2, 1]) == pytest.approx(entropy(by_source))
    assert solve_exponent([5, 40, 900], max_repeats=3, counts=[3, 2, 1]) == pytest.approx(solve_exponent(sizes, max_repeats=3))
    df = spark.range(4000).selectExpr("id doc_id", "repeat('word ', cast(id % 3 + 1 as int)) text", "concat('s', id) source")
    got = mix_sources(df, BYTE, max_repeats=2.0).groupBy("copies").count().collect()
    assert {r.copies for r in got} <= {1, 2} and sum(r["count"] for r in got) == 4000
