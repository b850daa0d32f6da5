"""BPE, token counts and token files against the libraries."""

import hashlib
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from kinfold.llm import bpe, token_counts, token_files
from kinfold.llm.pieces import pieces

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "'s", "'", "  ", "\n", "\t", " ", "é", "É", "1", "<|endoftext|>", "<|ENDOFTEXT|>", "<|endof", "ll", "\x1c", " ", "　", "🙂", "Σ", "ΑΣ ", "!!", "don't", "W.", "Word, ", "é", "́", "İ", "ß", "​", " ", "\x85", "\x00", " the", "and "]


def odd_texts(n=600, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 60))) for _ in range(n)] + ["", " ", "\n\n", "x" * 3000, "aé" * 500, " a" * 2000]


def edge_table(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    rows = [(3, "b a b", "en", 1), (1, None, None, 2), (2, "", "de", 3), (4, "word, " * 30_000, "en", 4), (3, "b a b", "en", 1), (None, "lost", "fr", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, id int").selectExpr("*", "lang as ids", "lang as n_tokens", "lang as start", "lang as source")


@pytest.fixture(scope="module")
def by_bytes():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def by_words():
    return Tokenizer.from_file(WORDS)


def test_pieces_join_to_the_text():
    assert all("".join(pieces(t)) == t for t in odd_texts())


def test_bpe_gives_the_librarys_ids_and_text(by_bytes):
    texts = odd_texts()
    got = bpe.Bpe(BYTES).encode_batch(texts)
    assert [x.tolist() for x in bpe.Bpe(BYTES).encode_array(pa.array(texts))] == got
    assert got == [e.ids for e in by_bytes.encode_batch(texts, add_special_tokens=False)]
    coder = bpe.Bpe(BYTES)
    assert [coder.decode(x) for x in got] == [by_bytes.decode(x, skip_special_tokens=False) for x in got]


def test_bpe_classes_every_assigned_code_point_like_the_library(by_bytes):
    """Pre-tokens, of which ids are a function; unassigned code points go through the library, some of them here too."""
    kinds = {c: unicodedata.category(chr(c)) for c in range(1, 0x110000)}
    points = [chr(c) for c, kind in kinds.items() if kind not in ("Cs", "Cn") or kind == "Cn" and c % 997 == 0]
    coder, library = bpe.Bpe(BYTES), by_bytes.pre_tokenizer
    for c in points:
        text = f"a{c}1{c}'ll !{c}"
        assert [w for p in pieces(text) for w in coder.words(p)] == [text[x:y] for _, (x, y) in library.pre_tokenize_str(text)], hex(ord(c))


def test_bpe_on_many_odd_texts(by_bytes):
    r = random.Random(77)
    rare = [chr(x) for x in (0x18D9D, 0x32426, 0x12680, 0x19017, 0x1C89, 0x558, 0x2FFFD, 0x1B168, 0x10FFFD, 0xE000, 0x300, 0x661, 0x2167)]
    texts = ["".join(r.choice(PARTS + rare) for _ in range(r.randint(0, 30))) for _ in range(10_000)]
    assert [x.tolist() for x in bpe.Bpe(BYTES).encode_array(pa.array(texts))] == [e.ids for e in by_bytes.encode_batch_fast(texts, add_special_tokens=False)]


def test_rank_array_and_heap_agree():
    coder, r = bpe.Bpe(BYTES), random.Random(1)
    for n in (2, 5, 17, 48):
        words = [bytes(r.choice(b"abcdeiourst \xc3\xa9") for _ in range(n)) for _ in range(50)]
        assert coder._short(words) == [coder._long(w) for w in words]


def test_cut_characters_decode_like_the_library(by_bytes):
    coder, ids = bpe.Bpe(BYTES), by_bytes.encode("🙂é", add_special_tokens=False).ids
    for k in range(1, len(ids)):
        assert coder.decode(ids[:k]) == by_bytes.decode(ids[:k], skip_special_tokens=False)


def test_bpe_on_edges(spark, by_bytes):
    df = edge_table(spark)
    rows = bpe.round_trip(df, BYTES).collect()
    assert len(rows) == 6
    for r in rows:
        text = {3: "b a b", 1: "", 2: "", 4: "word, " * 30_000, None: "lost"}[r.doc_id]
        ids = by_bytes.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    ids = bpe.encode(df, BYTES)
    assert {r.doc_id: r.text for r in bpe.decode(ids, BYTES).collect()}[3] == "b a b"
    assert bpe.round_trip(df.limit(0), BYTES).collect() == []


def test_counts_are_the_librarys(by_bytes):
    texts = odd_texts(seed=8)
    assert token_counts.Counter(BYTES).count(texts).tolist() == [len(e.ids) for e in by_bytes.encode_batch(texts, add_special_tokens=False)]


def test_splices_widen_and_stay_exact(by_bytes):
    r = random.Random(2)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 400))) for _ in range(300)] + ["x" * 3000 + " y" * 50]
    counter = token_counts.Counter(BYTES, chunk=64, overlap=8)
    assert counter.count(texts).tolist() == [len(e.ids) for e in by_bytes.encode_batch(texts, add_special_tokens=False)]
    assert counter.widened > 0


def test_a_blob_is_encoded_a_few_times_over_at_most(by_bytes):
    counter = token_counts.Counter(BYTES, chunk=256, overlap=8)
    done, encode = [], counter.of.encode

    class Counted:
        def encode(self, text, **kw):
            done.append(len(text))
            return encode(text, **kw)

    counter.of = Counted()
    text = "".join(random.Random(5).choice("abcdefghij") for _ in range(100_000))
    assert counter.spliced(text) == len(by_bytes.encode(text, add_special_tokens=False).ids)
    assert sum(done) < 12 * len(text)


def test_counts_on_edges(spark, by_bytes):
    rows = token_counts.count_tokens(edge_table(spark), BYTES).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows)[:2] == [("1", 0, 0, False), ("2", 0, 0, False)]
    long = next(r for r in rows if r.doc_id == 4)
    assert long.over_limit and long.n_tokens == len(by_bytes.encode("word, " * 30_000, add_special_tokens=False).ids)
    assert token_counts.count_tokens(edge_table(spark).limit(0), BYTES).collect() == []


def test_word_encoder_gives_the_librarys_ids(by_words):
    texts = odd_texts(seed=9)
    encoder = token_files.WordEncoder(WORDS)
    got = [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(pa.array(texts))]
    assert got == [e.ids for e in by_words.encode_batch(texts, add_special_tokens=False)]


def test_token_files_hold_all_ids_in_order(spark, by_words):
    r = random.Random(4)
    rows = [(i, None if i % 17 == 0 else "word " * r.randint(0, 900)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x.doc_id: x for x in token_files.token_files(df, WORDS, shard_bytes=100_000).collect()}
    start = 0
    for i, text in rows:
        ids = [*by_words.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_on_edges(spark):
    rows = token_files.token_files(edge_table(spark), WORDS).collect()
    assert len(rows) == 6 and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {1}
    assert sorted(r.start for r in rows)[0] == 0
    assert token_files.token_files(edge_table(spark).limit(0), WORDS).collect() == []


def shard_of(tmp_path, docs):
    writer = token_files.ShardWriter(f"file://{tmp_path}", 0, np.dtype("<u2"))
    writer.add(pa.array(range(len(docs)), pa.int64()), [x.tobytes() for x in docs])
    writer.close()
    return token_files.ShardReader(f"file://{tmp_path}/shard-000000.arrows")


def test_reader_is_zero_copy_within_a_batch(tmp_path):
    ids = np.arange(token_files.SEQ * token_files.ROWS + 10, dtype="<u2")
    reader = shard_of(tmp_path, [ids])
    assert reader.size == len(ids) and not reader.ids(5, 100).flags.owndata
    assert (reader.ids(0, len(ids)) == ids).all()
    with pytest.raises(ValueError):
        reader.ids(len(ids) - 1, 2)


def test_shards_tell_their_documents(tmp_path):
    r = np.random.default_rng(2)
    step = token_files.SEQ * token_files.ROWS
    sizes = [1, 5, step - 6, 1, 3 * step + 7, *r.integers(1, 3000, 400).tolist(), 2 * step]
    docs = [r.integers(0, 4, n).astype("<u2") for n in sizes]  # ids of documents have the end id within, too
    reader = shard_of(tmp_path, docs)
    starts = np.r_[0, np.cumsum(sizes)].tolist()
    assert list(reader.doc_ids()) == list(range(len(docs))) and reader.n_batches == -(-starts[-1] // step)
    assert list(reader.digests()) == [(a, len(x), zlib.crc32(x.astype("<u4").tobytes())) for a, x in zip(starts, docs)]
    for k in r.permutation(len(docs)):
        assert (reader.ids(starts[k], len(docs[k])) == docs[k]).all()
    table = pa.ipc.open_stream(pa.memory_map(f"{tmp_path}/shard-000000.arrows")).read_all()
    assert {n: str(t) for n, t in zip(table.schema.names, table.schema.types)} == {"ids": "fixed_size_list<item: uint16>[1024]", "mask": "fixed_size_list<item: bool>[1024]", "last": "fixed_size_list<item: bool>[1024]"}


def test_known_keeps_what_is_asked_for_again():
    from kinfold.llm.pieces import Known

    asked = []
    known = Known(lambda words: [asked.append(w) or (w, w.upper()) for w in words], 3)
    assert known(["a", "b", "c"]) == ["A", "B", "C"]
    assert known(["c", "d", "e"]) == ["C", "D", "E"]  # past the limit: only what isn't asked for goes
    assert asked == ["a", "b", "c", "d", "e"] and len(known.held) == 3


def test_letters_are_not_searched_for_unknown_code_points(monkeypatch):
    encoder = bpe.loaded(public_tokenizers.path("byte_bpe_50k.json"))
    looked = []
    search = encoder.unknown
    monkeypatch.setattr(encoder, "unknown", lambda piece: looked.append(piece) or search(piece))
    assert [encoder.words(p) for p in (" été", "日本", " où.", "naïf-1")] == [[" été"], ["日本"], [" où", "."], ["naïf", "-", "1"]]
    assert looked == []
    assert encoder.words(" 日͸") and looked == [" 日͸"]
