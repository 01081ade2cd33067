"""Every operator of the pipeline list on small inputs: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from warraq.llm import chat, common, jaccard, langid, lengths, neardup, packing, pieces, quality, toxicity, warc

PIECE = public_tokenizers.path("piece_bpe_32k.model")
WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id bigint, text string, lang string, kept string, e string"
TEXTS = [None, "", " ", "a", "Hello world", "x\n\ny  z", "▁mark <0x0A> </s>", "日本語 テスト 😀", "\x00 nul", "A b C d e f g " * 300, "İstanbul Σας it's we'LL <|endoftext|>", "q" * 5000, "Hello world"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, x, "en", "clash", "clash") for k, x in enumerate(TEXTS)] + [(4, "Hello world", "en", "clash", "clash"), (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# ---- pieces, packing, quality, lengths ----


def test_pieces_match_the_library_and_cover_the_source(docs, none):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = docs.select("text", pieces.encoded(F.col("text"), PIECE).alias("e")).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        ids = lib.encode(r.text or "")
        assert r.e.ids == ids and r.e.decoded == lib.decode(ids)
        assert r.e.offsets == sorted(r.e.offsets) and r.e.offsets[-1] == len((r.text or "").encode()) and len(r.e.offsets) == len(ids) + 1
    assert none.select(pieces.encoded(F.col("text"), PIECE)).collect() == []


def test_each_piece_spells_its_span():
    e = pieces.PieceEncoder(PIECE)
    for text in [t for t in TEXTS if t]:
        ids, offsets = e.encode([text])[0]
        data, strings = text.encode(), [e.library.id_to_piece(int(i)) for i in ids]
        for k, s in enumerate(strings):
            part = data[offsets[k] : offsets[k + 1]]
            if not e.is_byte[ids[k]]:
                assert part.decode().replace(" ", "▁") in (s, s.removeprefix("▁"))
            else:
                assert part == bytes([int(s[3:5], 16)])


def test_models_with_other_normalisers_encode_as_the_library_does(tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    try:
        norm = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    except Exception as e:  # noqa: BLE001 - older libraries have no normaliser of their own
        pytest.skip(str(e))
    rule = sentencepiece_model_pb2.ModelProto()
    rule.ParseFromString(norm.serialized_model_proto())
    rng = np.random.default_rng(10)
    signs = list("ab  c\t\n") + ["ﬁ", "①", "Ａ", "　", "ｶﾞ", "e\u0301", "日", "😀", "▁", "the", "[X]", "\u200b"]
    texts = ["", " ", "  a  b ", "[X]", "a[X] b", *("".join(rng.choice(signs, int(n))) for n in rng.integers(1, 30, 200))]
    for mapped in (False, True):
        for dummy in (False, True):
            for extra in (False, True):
                for symbol in (False, True):
                    proto = sentencepiece_model_pb2.ModelProto()
                    proto.ParseFromString(open(PIECE, "rb").read())
                    spec = proto.normalizer_spec
                    spec.precompiled_charsmap = rule.normalizer_spec.precompiled_charsmap if mapped else b""
                    spec.add_dummy_prefix, spec.remove_extra_whitespaces = dummy, extra
                    if symbol:
                        proto.pieces[-1].piece, proto.pieces[-1].type = "[X]", 4
                    path = tmp_path / "m.model"
                    path.write_bytes(proto.SerializeToString())
                    lib = sentencepiece.SentencePieceProcessor(model_file=str(path))
                    got = pieces.PieceEncoder(str(path)).encode(texts)
                    assert [x.tolist() for x, _ in got] == lib.encode(texts), (mapped, dummy, extra, symbol)
                    for t, (_, offsets) in zip(texts, got, strict=True):
                        assert offsets.tolist() == sorted(offsets.tolist()) and offsets[-1] == len(t.encode())


def test_normalisation_through_a_compiled_map():
    import sentencepiece

    from warraq.llm.charmap import CharMap, normalise

    try:
        norm = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    except Exception as e:  # noqa: BLE001 - older libraries have no normaliser of their own
        pytest.skip(str(e))
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.NormalizerSpec()
    proto.ParseFromString(norm.serialized_model_proto()) if hasattr(norm, "serialized_model_proto") else None
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(norm.serialized_model_proto())
    chars = CharMap(model.normalizer_spec.precompiled_charsmap)
    assert chars.units
    for text in ["ﬁne ①②", "ＡＢＣ　ｄ", "a\tb\nc", "ガギ", "café", "Å x", ""]:
        got, source = normalise(text, chars, False, False, False)
        assert got.decode() == norm.normalize(text)
        assert len(source) == len(got) + 1 and source.tolist() == sorted(source.tolist())


def test_packing_is_a_partition_of_every_document(docs, none):
    import zlib

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    rows = packing.packed(docs, WORD, 64, 0, with_ids=True).collect()
    by_doc: Counter = Counter()
    for r in rows:
        assert r.length == len(r.ids) <= 64 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc[r.doc_id] += r.length
    want: Counter = Counter()
    for r in docs.collect():
        want[r.doc_id] += len(t.encode(r.text or "", add_special_tokens=False).ids) + 1
    assert by_doc == want
    for r in docs.where("doc_id = 9").collect():
        ids = [i for p in sorted((p.piece, p.start, p.ids) for p in rows if p.doc_id == 9) for i in p[2]]
        assert ids == [*t.encode(r.text, add_special_tokens=False).ids, 0]
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= -(-sum(want.values()) // 64) + 2
    assert packing.packed(none, WORD, 64).collect() == []


def test_words_are_encoded_as_the_library_does_by_default(tmp_path):
    import json

    from tokenizers import Tokenizer

    from warraq.llm import tokens

    lib, e = Tokenizer.from_file(WORD), tokens.WordEncoder(WORD)
    texts = ["<|endoftext|> a", "a<|endoftext|>b<|startoftext|>", "<|ENDOFTEXT|> x", "don't WE'LL 's", "a\u00a0b\u2003c \x1c d", "e\u0301 \u212a", *[t for t in TEXTS if t], "word " * 20_000 + "<|endoftext|>"]
    assert e.by_word and e.encode(["<|endoftext|> a"])[0].tolist() == [49407, 320]
    rng = np.random.default_rng(6)
    signs = list("ab É'sß0.<|>\u0301\u3000日😀\n") + ["<|endoftext|>", "'ll", "ﬁ"]
    texts += ["".join(rng.choice(signs, 40)) for _ in range(300)]
    assert [x.tolist() for x in e.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    other = json.load(open(WORD))
    other["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = "[^x]+"
    path = tmp_path / "other.json"
    path.write_text(json.dumps(other))
    e, lib = tokens.WordEncoder(str(path)), Tokenizer.from_file(str(path))
    assert not e.by_word and e.encode(["a b", None])[0].tolist() == lib.encode("a b", add_special_tokens=False).ids


def test_words_with_runs_of_signs_need_only_the_merges(monkeypatch):
    from tokenizers import Tokenizer

    from warraq.llm import tokens

    lib, e = Tokenizer.from_file(WORD), tokens.WordEncoder(WORD)
    plain = [w + s for w in ("word", "Été", "") for s in ("###", "$$$", "&&&!", ').*+-/=>@[\\]^_`{}~"')]
    other = ["'s###", "don't###", "(a", "<|endoftext|>###", "a<", "#\u0301", "9#"]
    texts = [" ".join(plain), None, "", " \t", "\x0b a\x0c", *other, " ".join([*other, *plain])]
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    whole, chain = [], e.tokenizer
    e.tokenizer = type("Counted", (), {"encode": lambda self, w, **how: whole.append(w) or chain.encode(w, **how)})()
    assert [x.tolist() for x in e.encode(texts)] == want and sorted(whole) == sorted(other)
    # a full store begins anew, which changes no result
    monkeypatch.setattr(tokens, "MAX_STORED", 3)
    assert [e.encode([t])[0].tolist() for t in texts * 2] == want * 2 and len(e.kept.number) <= 3 + len(set(texts[-1].split()))


def test_special_strings_of_plain_signs_are_left_to_the_library(tmp_path):
    import json

    from tokenizers import Tokenizer

    from warraq.llm import tokens

    spec = json.load(open(WORD))
    spec["added_tokens"].append(spec["added_tokens"][0] | {"id": 256, "content": "!!"})
    path = tmp_path / "signs.json"
    path.write_text(json.dumps(spec))
    texts = ["a!! b", "word !!!", "b!"]
    want = [Tokenizer.from_file(str(path)).encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in tokens.WordEncoder(str(path)).encode(texts)] == want


def test_best_fit_takes_the_tightest_bin():
    bins = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert sorted(np.bincount(bins, weights=[6, 5, 4, 3, 2]).tolist()) == [10, 10]
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 2048, 3000)
    total = np.bincount(packing.best_fit(sizes, 2048), weights=sizes)
    # no packing can do with fewer than the volume, nor than the items over half a bin
    least = max(sizes.sum() / 2048, (sizes > 1024).sum())
    assert total.max() <= 2048 and len(total) <= 1.02 * least + 1


def test_packing_in_rounds_is_near_the_bound(spark):
    rng = np.random.default_rng(1)
    rows = [(k, 0, 0, int(n), 0) for k, n in enumerate(rng.integers(1, 900, 3000))]
    p = spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint").withColumn("ids", F.lit(None).cast("array<int>")).repartition(40)
    out = packing.pack(p, 1000).collect()
    assert len(out) == 3000 and len({r.sequence_id for r in out}) <= sum(r[3] for r in rows) / 1000 * 1.01 + 2


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    marked = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(k, k + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def brute_script(text):
    found = Counter(next((n for n, ranges in quality.SCRIPTS.items() if any(a <= ord(c) <= b for a, b in ranges)), "other") for c in text if c.isalpha())
    return max([*quality.SCRIPTS, "other"], key=lambda n: found[n]) if found else "none"


@lru_cache(maxsize=1)
def libraries():
    import base64

    import sentencepiece
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return sentencepiece.SentencePieceProcessor(model_file=PIECE), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def brute_fertility(text):
    """The figures from the libraries' own calls: a token is broken if it is a byte piece, or its bytes are no text."""
    pieces_, ranks = libraries()
    free, out = sum(text.count(c) for c in "\n\r\t"), []
    for ids, broken in ((pieces_.encode(text), pieces_.is_byte), (ranks.encode_ordinary(text), lambda i: "\ufffd" in ranks.decode_single_token_bytes(i).decode("utf-8", "replace"))):
        n, count = len(ids), Counter(ids)
        entropy = -sum(c / n * np.log2(c / n) for c in count.values())
        known = {i: bool(broken(i)) for i in count}
        out += [len(text) / n, max(0, sum(map(known.get, ids)) - free) / n, entropy / np.log2(n) if n > 1 else 1.0] if n else [0.0, 0.0, 0.0]
    return tuple(out)


def test_fertility_of_long_runs():
    v = quality.Vocabularies(PIECE, RANKS, public_tokenizers.PATTERN)
    for text in (" " * 2_000_000, "a" * 500_000, "a b" + "\n" * 300_000 + "c"):
        assert len(v.figures([text])[0]) == 6
    assert v.byte_ids("a  b c").tolist() == libraries()[1].encode_ordinary("a  b c") and len(v.byte_ids("")) == 0


@pytest.mark.parametrize("text", [*TEXTS, "a b c a b c", "x y x y x y", "l\nl\n \n l\nl", "# $\x1cx|", "a b c d a b c"])
def test_quality_counts(text):
    assert quality.base(text or "") == brute_quality(text)


def test_quality_verdicts(spark, none):
    good = " ".join(f"{w} {v}{k}" for k in range(9) for w in ("plain", "words", "about", "nothing") for v in ("river", "stone", "window", "garden", "letter"))
    rows = spark.createDataFrame([(0, good), (1, None), (2, "too short"), (3, "same same same " * 60), (4, "Öß" + "𓀀𓁀𓂀 " * 80 + good[:40])], "doc_id bigint, text string").select("doc_id", quality.judged(F.col("text"), PIECE, RANKS, public_tokenizers.PATTERN).alias("q"))
    got = {r.doc_id: r.q for r in rows.collect()}
    assert got[0].kept and not got[1].kept and got[1].n_words == 0 and got[2].base_failed and got[3].base_failed and not got[4].kept
    assert none.select(quality.judged(F.col("text"), PIECE, RANKS, public_tokenizers.PATTERN)).collect() == []


SENTENCES = {
    "latin": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi.",
    "arabic": "يولد جميع الناس أحراراً متساوين في الكرامة والحقوق وقد وهبوا عقلاً وضميراً",
    "cyrillic": "Все люди рождаются свободными и равными в своем достоинстве и правах",
    "han": "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心",
    "hangul": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다",
    "kana": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
    "greek": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια",
    "hebrew": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם",
    "indic": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता মনুষ্য স্বাধীনভাবে சுதந்திரமாகவே",
    "thai": "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ ต่างมีเหตุผลและมโนธรรม",
    "georgian": "ყველა ადამიანი იბადება თავისუფალი და თანასწორი თავისი ღირსებითა და უფლებებით",
    "armenian": "Բոլոր մարդիկ ծնվում են ազատ ու հավասար իրենց արժանապատվությամբ ու իրավունքներով",
    "ethiopic": "የሰው ልጅ ሁሉ ሲወለድ ነጻና በክብርና በመብትም እኩልነት ያለው ነው። የተፈጥሮ ማስተዋልና ሕሊና ስላለው",
    "khmer": "មនុស្សទាំងអស់កើតមកមានសេរីភាពនិងភាពស្មើៗគ្នាក្នុងសិទ្ធិនិងសេចក្ដីថ្លៃថ្នូរ",
    "burmese": "လူတိုင်းသည် တူညီ လွတ်လပ်သော ဂုဏ်သိက္ခာဖြင့် လည်းကောင်း တူညီလွတ်လပ်သော အခွင့်အရေးများဖြင့်",
    "other": "ᏂᎦᏓ ᎠᏂᏴᏫ ᏂᎨᎫᏓᎸᎾ ᎠᎴ ᎤᏂᏠᏱ ᎤᎾᏕᎿ ᏚᏳᎧᏛ ᎨᏒᎢ",
}


def random_words(rng, first: int, letters: int, size: int = 9) -> str:
    return " ".join("".join(chr(first + int(x)) for x in rng.integers(0, letters, size)) for _ in range(70))


def test_fertility_bands():
    import base64

    v, rng = quality.Vocabularies(PIECE, RANKS, public_tokenizers.PATTERN), np.random.default_rng(4)

    def verdict(text):
        return quality.script(text), quality.within(quality.script(text), v.figures([text])[0])

    assert {n for n in quality.BANDS} == {*SENTENCES, "none"}
    for name, text in SENTENCES.items():
        assert verdict(text) == (name, True), (name, v.figures([text]))
    junk = {
        "latin": [" ".join(base64.b64encode(rng.bytes(30)).decode() for _ in range(60)), " ".join(rng.bytes(16).hex() for _ in range(60)), "ha " * 300, "Ã©Ã¨Ã¼ â€™ Ã¶Ã¤ " * 30],
        "none": ["0123 456 789 " * 30, " ".join(str(n) for n in rng.integers(0, 10**9, 80)), "😀😂🎉 👍🔥 " * 40, "─│┌┐└┘├┤ " * 60, "#$% ^&* ()_ +-= " * 30, random_words(rng, 0xE000, 500)],
        "other": [random_words(rng, 0x13000, 900), random_words(rng, 0x12000, 900), "\u13a0 " * 200],
        "han": [random_words(rng, 0x4E00, 20_000), "\u4e00\u4e8c " * 150],
        "georgian": ["\u10d0\u10d1 " * 150],
        "thai": ["\u0e01\u0e02 " * 150],
        "indic": ["\u0915\u0916 " * 150],
        "ethiopic": ["\u1200\u1208 " * 150],
    }
    for name, texts in junk.items():
        for text in texts:
            assert verdict(text) == (name, False), (name, text[:30], v.figures([text]))


def test_length_sums_answer_every_limit(docs, none):
    sums = lengths.suffix_sums(lengths.histogram(docs, PIECE)).cache()
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    n = sorted(len(lib.encode(r.text or "")) for r in docs.collect())
    rows = {r.n_tokens: r for r in sums.collect()}
    assert set(rows) == set(n)
    for limit, r in rows.items():
        assert r.docs_from == sum(x >= limit for x in n) and r.tokens_from == sum(x for x in n if x >= limit)
        assert r.truncated_tokens == sum(min(x, limit) for x in n) and r.docs_within == sum(x <= limit for x in n)
    for limit in (0, 1, 7, 10**6):
        assert lengths.truncated_total(sums, limit).first()[0] == sum(min(x, limit) for x in n)
    assert lengths.quantile(sums, 0.5).first()[0] == n[-(-len(n) // 2) - 1]
    assert lengths.suffix_sums(lengths.histogram(none, PIECE)).collect() == []


# ---- chat ----

TRICKY = ["\\### Assistant: </turn> ok", "<turn></role></turn>\n</turn>", "<\\turn>", "\\", "", None, "a\n\n</turn", "é😀 ñ", "<<turn>>"]


def test_chat_round_trip_and_masks(spark):
    rows = [(c, k, r, x) for c, shift in ((1, 0), (2, 3), (None, 1)) for k, (r, x) in enumerate(zip(["system", "user", "assistant", "assistant", None, "user", "assistant", "a:b\n", "assistant"], TRICKY[shift:] + TRICKY[:shift], strict=True))]
    rows += [(3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("ids", F.lit("clash"))
    blocks = chat.format_conversations(turns, BYTE)
    got = {r.conv_id: r for r in chat.digests(blocks).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv, r in got.items():
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1], x[2] or "", x[3] or ""))
        whole = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for b in blocks.collect():
        assert [b.formatted[x:y] for x, y in zip(b.text_starts, b.text_ends, strict=True)] == [chat.escape(t) for _, t in chat.parse(b.formatted)]


def test_chat_blocks_split_between_turns(spark, monkeypatch):
    rows = [(1, k, "user" if k % 2 else "assistant", f"text {k} ") for k in range(500)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    whole = chat.digests(chat.format_conversations(turns, BYTE)).first()
    monkeypatch.setattr(chat, "BLOCK_CHARS", 200)
    lot = list(chat._blocks([turns.toArrow().to_batches()[0]] if len(turns.toArrow().to_batches()) == 1 else turns.coalesce(1).toArrow().to_batches(), BYTE))
    assert sum(b.num_rows for b in lot) > 20
    parts = "".join(x for b in lot for x in b.column("formatted").to_pylist())
    assert len(parts) == whole.formatted_chars and len(chat.parse(parts)) == 500


def test_chat_on_no_rows(spark):
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.digests(chat.format_conversations(turns, BYTE)).collect() == []


# ---- WARC ----


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c\r\nX: y", None), (4, "u", ""), (5, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (6, "u", "é\r\n\r\n"), (None, "u", "<p>x</p>"), (7, "u", "z" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("record", F.lit("clash"))
    path = common.scratch_path(spark, "warc-test")
    warc.write(pages, path)
    got = {r.record_id: r for r in warc.read(spark, path).collect()}
    assert len(got) == len(rows) and all(r.kind == "record" for r in got.values())
    for page_id, _, html in rows:
        r = got[f"<urn:page:{'null' if page_id is None else page_id}>"]
        data = (html or "").encode()
        import base64

        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        if r.record_type == "response":
            assert bytes(r.payload) == data
    assert got["<urn:page:1>"].refers_to == "<urn:page:2>" and got["<urn:page:null>"].record_type == "revisit" and got["<urn:page:2>"].record_type == "response"
    assert got["<urn:page:3>"].refers_to == "<urn:page:4>"


def _archive(spark, n=6):
    pages = spark.createDataFrame([(k, f"u{k}", f"<p>page {k}</p>" * (k + 1)) for k in range(n)], "page_id bigint, url string, html string")
    return [(r.record + "\r\n\r\n").encode() for r in warc.records(pages).orderBy("page_id").collect()]


@pytest.mark.parametrize("gz", [False, True])
@pytest.mark.parametrize("damage", ["none", "flip", "cut", "junk", "length"])
def test_salvage(spark, gz, damage):
    plain = _archive(spark)
    parts = [warc.gzip_members(p) for p in plain] if gz else plain
    lost: set[int] = set()
    if damage == "flip":
        k = len(parts[2]) - 12
        parts[2] = parts[2][:k] + bytes([parts[2][k] ^ 0x55]) + parts[2][k + 1 :]
        lost = {2}
    elif damage == "cut":
        parts[5] = parts[5][:-20]
        lost = {5}
    elif damage == "junk":
        parts[3] = b"\x1f\x8b\x08junk WARC/1.1 junk" + parts[3]
    elif damage == "length" and not gz:
        parts[1] = parts[1].replace(b"Content-Length: ", b"Content-Length: 9", 2)
        lost = {1}
    data = b"".join(parts)
    rows = list(warc.salvage(data))
    assert sum(r["length"] for r in rows) == len(data) and [r["offset"] for r in rows] == sorted(r["offset"] for r in rows)
    assert {r["record_id"] for r in rows if r["kind"] == "record"} == {f"<urn:page:{k}>" for k in range(6) if k not in lost}
    assert (damage in ("none",) or damage == "length" and gz) == all(r["kind"] == "record" for r in rows)
    assert all(r["reason"] for r in rows if r["kind"] == "gap")
    assert list(warc.salvage(b"")) == []


def test_salvage_is_linear_in_damage():
    import time

    record = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <a>\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    for junk in (b"WARC/1.0\r\nx", b"WARC/1.0\nx", b"WARC/1.0\r\nx: y\r\n", b"WARC/1.0\r\na:WARC/1.1", b"\x1f\x8b\x08", b"\x1f\x8b\x08\x00", b"WARC/1.1\r\nContent-Length: 3\r\n\r\n"):
        data, start = junk * (2_000_000 // len(junk)) + b"\r\n\r\n" + record, time.time()
        rows = list(warc.salvage(data))
        assert [r["kind"] for r in rows] == ["gap", "record"] and rows[1]["record_id"] == "<a>"
        assert time.time() - start < 10, junk
    # a header that is longer than the bound is a failed check; candidates that share a blank line are told apart
    long = record.replace(b"Content-Length", b"X: " + b"y" * 70_000 + b"\r\nContent-Length")
    assert [r["kind"] for r in warc.salvage(long + record)] == ["gap", "record"]
    nested = b"WARC/1.1\r\nno colon\r\n" + record
    assert [(r["kind"], r["offset"]) for r in warc.salvage(nested)] == [("gap", 0), ("record", 20)]


def test_warc_archives_are_bounded_and_repeated_ids_answer(spark, monkeypatch):
    monkeypatch.setattr(warc, "SMALL", 100)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1000)
    rows = [(k, "u", "x" * (k % 7 * 40)) for k in range(60)] + [(3, "u", "other"), (3, "u", "other"), (5, "u", "other"), (70, None, "y" * 5000)]
    path = common.scratch_path(spark, "warc-test")
    warc.write(spark.createDataFrame(rows, "page_id bigint, url string, html string"), path)
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows) and all(r.kind == "record" for r in got)
    assert max(Counter(r.path for r in got).values()) <= 10
    by = {}
    for page, _, html in rows:
        by.setdefault(html, []).append(page)
    want = [(page, None if page == max(by[html]) else max(by[html]), len(html)) for page, _, html in rows]
    name = lambda x: None if x is None else int(x[len("<urn:page:") : -1])
    assert sorted(((name(r.record_id), name(r.refers_to), r.payload_bytes) for r in got), key=str) == sorted(want, key=str)


# ---- language, toxicity ----


def brute_phrases(learned: str, text: str) -> int:
    at = n = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in learned:
            k += 1
        at, n = at + k, n + 1
    return n


def test_cross_parsing_counts_greedy_phrases(monkeypatch):
    rng = np.random.default_rng(3)
    for stretch in (1, 7, 512):
        monkeypatch.setattr(langid, "STRETCH", stretch)
        for _ in range(8):
            learned = "".join(rng.choice(list("ab c"), 60))
            texts = ["".join(rng.choice(list("ab cd é日"), int(n))) for n in rng.integers(0, 90, 12)] + [learned * 3, learned[9:50], "z", ""]
            bits, size = langid.Model({"x": learned}).entropies(texts)
            spelt = langid.spelt(learned).decode("latin-1")
            want = [brute_phrases(spelt, langid.spelt(t).decode("latin-1")) for t in texts]
            assert np.allclose(bits[:, 0] * np.maximum(1, size), np.array(want) * np.log2(len(spelt)))


def test_a_text_that_was_learned_is_one_phrase():
    rng = np.random.default_rng(8)
    learned = "".join(rng.choice(list("abcdefgh "), 20_000))
    learned = langid.spelt(learned).decode()
    assert langid.Model({"x": learned}).entropies([learned])[0][0, 0] * len(learned) == pytest.approx(np.log2(len(learned)))


def test_every_language_is_learned_in_any_script(spark):
    first = {f"l{k:02d}": [chr(0x4E00 + 40 * k + j) for j in range(30)] for k in range(60)}
    rng = np.random.default_rng(12)
    write = lambda letters, n: " ".join("".join(rng.choice(letters, 4)) for _ in range(n))
    rows, held = [], [k for k in range(2000) if zlib.crc32(str(k).encode()) % 4 == 2]
    free = [k for k in range(2000) if zlib.crc32(str(k).encode()) % 4 != 2]
    for n, (name, letters) in enumerate(first.items()):
        rows += [(free[n], write(letters, 40), name, None, None), (held[n], write(letters, 12), name, None, None)]
    rows.append((free[70], write(first["l00"], 9000), "l00", None, None))  # longer than the sample takes
    d = spark.createDataFrame(rows, DOCS)
    learned = langid.samples(d)
    assert set(learned) == set(first) and max(map(len, learned.values())) <= langid.SAMPLE_CHARS + langid.SAMPLE_DOCS
    got = d.select("lang", langid.identified(d, F.col("text"), learned)["lang_pred"].alias("p")).collect()
    assert all(r.lang == r.p for r in got)
    # equal samples tie, and the first by name wins
    assert d.select(langid.identified(d, F.lit("abc"), {"b": "abc abd", "a": "abc abd"})["lang_pred"]).first()[0] == "a"


EN, FR = "the quick brown fox jumps over the lazy dog and runs away ", "le renard brun saute par dessus le chien paresseux et court "


def test_languages(spark, none):
    rows = [(k, (EN if k % 2 else FR) * (1 + k % 3), "en" if k % 2 else "fr", None, None) for k in range(60)] + [(100, None, "en", None, None), (101, " 12 !", "en", None, None), (102, "", None, None, None), (103, EN, None, None, None), (None, FR * 900, "fr", None, None)]
    d = spark.createDataFrame(rows, DOCS)
    learned = langid.samples(d)
    assert set(learned) == {"en", "fr"}
    got = d.select("doc_id", "lang", "text", langid.identified(d, F.col("text"), learned).alias("g")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (100, 101, 102):
            assert r.g.lang_pred == "und" and r.g.score == 0
        else:
            assert r.g.lang_pred == ("en" if r.text.startswith("the") else "fr") and 0 <= r.g.score <= 1
    assert none.select(langid.identified(none, F.col("text"), langid.samples(none))).collect() == []
    assert d.select(langid.identified(d, F.col("text"), {})["lang_pred"]).distinct().first()[0] == "und"


def test_neighbours_are_exact():
    rng = np.random.default_rng(5)
    vectors = [{int(t): int(rng.integers(1, 5)) for t in rng.choice(30, rng.integers(1, 8), replace=False)} for _ in range(500)]
    index = toxicity.Index(vectors, rng.integers(0, 2, 500).tolist(), [1.0] * 500, list(range(500)), 30)
    unit = [index.unit(vectors[k]) for k in index.keys]
    for q in [*vectors[:40], {0: 1}, {29: 3, 1: 1}]:
        t, w = index.unit(q)
        dense = np.zeros(30)
        dense[t] = w
        cos = np.round(np.array([dense[a] @ b for a, b in unit]), 12)
        want = np.lexsort((np.arange(500), -cos))[: toxicity.NEIGHBOURS]
        n, c = index.nearest(q)
        keep = cos[want] > 0
        assert np.allclose(c, cos[want][keep], atol=1e-11) and n.tolist() == want[keep].tolist()


def test_few_examples_are_opened_and_lots_change_nothing(monkeypatch):
    rng, k = np.random.default_rng(8), toxicity.NEIGHBOURS
    vectors = [{0: 9, **{int(t): int(rng.integers(1, 5)) for t in (rng.random(300) ** 3 * 300).astype(int)[:40]}} for _ in range(2500)]
    index = toxicity.Index(vectors, [0] * 2500, [1.0] * 2500, list(range(2500)), 300)
    dense = np.zeros((2500, 300))
    for row, key in zip(dense, index.keys, strict=True):
        t, w = index.unit(vectors[key])
        row[t] = w
    opened, best = [], toxicity._best
    monkeypatch.setattr(toxicity, "_best", lambda n, cosines, k: opened.append(len(n)) or best(n, cosines, k))
    units = [index.unit(v) for v in [*vectors[:70], {0: 1}, {299: 2}, {}]]
    alone = [index.nearest_to(t, w) for t, w in units]
    assert sum(opened[:70]) < 1.5 * k * 70
    for (t, w), (n, c) in zip(units, alone, strict=True):
        cos = np.round(dense[:, t] @ w, 12)
        want = [x for x in np.lexsort((np.arange(2500), -cos))[:k] if cos[x] > 0]
        assert np.allclose(c, cos[want], atol=2e-12) and np.allclose(cos[n], cos[want], atol=2e-12)
    for (n, c), (m, d) in zip(index.nearest_to_each(units), alone, strict=True):
        assert n.tolist() == m.tolist() and c.tolist() == d.tolist()


def test_texts_of_a_lot_have_the_vectors_they_have_alone():
    words = np.array(sorted(map(toxicity.hashed, ["vile", "thing", "x2"])), np.uint64)
    model = toxicity.Model({"terms": ["vile", "thi*"], "words": words, "totals": {}, "rows": []})
    texts = ["a Vile thing, x2 vile", "", "thing thing other", "no known word", "vile a x2 THING vile"]
    lot = [(t.tolist(), n.tolist()) for t, n in model.vectors(texts)]
    assert lot == [(t.tolist(), n.tolist()) for t, n in map(model.vector, texts)]
    assert lot[0] == lot[4] and lot[1] == ([], []) and lot[2][0][:2] == [0, 2] and lot[0][0][:3] == [0, 1, 2] and sorted(lot[0][0][3:]) == [-1, 3, 4, 5]


def test_toxicity(spark, none):
    plain = [f"word{k % 17} goes{k % 11} with{k % 7} things{k % 5} and more " * 8 for k in range(400)]
    rows = [(k, x + (" you vile swine " * 3 if k % 5 == 0 else ""), None, None, None) for k, x in enumerate(plain)] + [(900, None, None, None, None), (901, "", None, None, None)]
    d = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(400)] + [(0, 0), (401, None), (None, 1)], "doc_id bigint, toxic int")
    learned = toxicity.learn(d, labels)
    got = {r.doc_id: r.t for r in d.select("doc_id", toxicity.scored(d, F.col("text"), learned).alias("t")).collect()}
    assert all((got[k].score >= 0.3) == (k % 5 == 0) for k in range(400))
    assert 0 < got[900].score < 1 and got[900].score == got[901].score and got[900].evidence == []
    assert got[5].evidence and got[5].evidence[0].toxic == 1 and all(0 <= t.score <= 1 for t in got.values())
    unlabelled = toxicity.learn(d, labels.limit(0))
    assert {r[0] for r in d.select(toxicity.scored(d, F.col("text"), unlabelled)["score"]).collect()} == {0.5}
    assert none.select(toxicity.scored(none, F.col("text"), unlabelled)).collect() == []


def test_rare_toxic_terms_count_beside_a_strong_one(spark):
    plain = [f"word{k % 17} goes{k % 11} with{k % 7} things{k % 5} and more " * 4 for k in range(800)]
    rows = [(k, x + (" vile" if k % 2 else "") + (" zorblat" if k % 40 == 1 else ""), None, None, None) for k, x in enumerate(plain)]
    rows += [(900, plain[0] + " zorblat", None, None, None), (901, plain[0], None, None, None)]
    d = spark.createDataFrame(rows, DOCS)
    learned = toxicity.learn(d, spark.createDataFrame([(k, k % 2) for k in range(800)], "doc_id bigint, toxic int"))
    assert {"vile", "zorblat"} <= set(learned["terms"])
    got = {r.doc_id: r.t for r in d.where("doc_id >= 900").select("doc_id", toxicity.scored(d, F.col("text"), learned).alias("t")).collect()}
    assert got[900].score > got[901].score and all(e.toxic == 1 for e in got[900].evidence)


def test_neighbours_are_found_by_all_words(spark):
    plain = [f"alpha{k % 17} beta{k % 11} gamma{k % 7} delta{k % 5} and more " * 4 for k in range(400)]
    rows = [(k, x + (" vile" if k % 2 else ""), None, None, None) for k, x in enumerate(plain)]
    odd = "none of these plain sentences holds the strong word"
    labelled = next(k for k in range(501, 540) if zlib.crc32(str(k).encode()) % 4 != 2)
    d = spark.createDataFrame([*rows, (labelled, odd, None, None, None), (900, odd, None, None, None)], DOCS)
    learned = toxicity.learn(d, spark.createDataFrame([*((k, k % 2) for k in range(400)), (labelled, 1)], "doc_id bigint, toxic int"))
    first = d.where("doc_id = 900").select(toxicity.scored(d, F.col("text"), learned)["evidence"].alias("e")).first().e[0]
    assert (first.doc_id, first.toxic) == (labelled, 1) and first.cosine == pytest.approx(1, abs=1e-9)


def test_equal_cosines_do_not_go_by_label():
    index = toxicity.Index([{0: 1}] * 60, [1] * 30 + [0] * 30, [1.0] * 60, list(range(60)), 1)
    assert [index.keys[n] for n in index.nearest({0: 1})[0]] == list(range(toxicity.NEIGHBOURS))


# ---- near duplicates ----


def components_of(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute_jaccard(texts):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, components_of(len(texts), links)


def family_texts(seed, n=160):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    fresh = lambda m: [vocabulary[k] for k in rng.integers(0, 4000, m)]
    bases, passage, texts = [fresh(int(rng.integers(20, 120))) for _ in range(8)], fresh(60), []
    for _ in range(n):
        kind = rng.random()
        words = list(bases[int(rng.integers(0, 8))]) if kind < 0.7 else passage + fresh(int(rng.integers(5, 40))) if kind < 0.85 else fresh(int(rng.integers(1, 80)))
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(0, len(words)))] = fresh(1)[0]
        if rng.random() < 0.3:
            words = words[: max(1, int(len(words) * rng.uniform(0.7, 1)))]
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("short", [6, 2])
def test_jaccard_components(spark, monkeypatch, short):
    monkeypatch.setattr(jaccard, "SHORT", short)
    texts = [None, "", "  ", "one two", "ONE\ttwo", "three", "a b c d e", "A B C D E ", *family_texts(short)]
    rows = [(k, x, "clash", "clash") for k, x in enumerate(texts)] + [(3, "one two", "clash", "clash"), (None, "a b c d e", "", "")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, n string, rep string").repartition(5)
    sets, want = brute_jaccard(texts)
    links = brute_links([t for k, t, *_ in rows if k is not None])
    got = jaccard.near_duplicates(d, 75, 5).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.n_shingles == 1 and r.n_links == 0
        else:
            assert (r.n_shingles, r.component_id, r.n_links) == (len(sets[r.doc_id]), want[r.doc_id], links[r.doc_id])


def brute_links(texts):
    """The other rows that each row links with."""
    sets = brute_jaccard(texts)[0]
    return [sum(a != b and bool(s) and bool(t) and 100 * len(s & t) >= 75 * len(s | t) for b, t in enumerate(sets)) for a, s in enumerate(sets)]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_with_repeated_ids(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "PART_SETS", 12)
    texts = family_texts(30 + seed, 120) + [None, "", "a b c d e f g h"]
    rng = np.random.default_rng(seed)
    ids = [int(k) for k in rng.integers(0, 70, len(texts))]
    rows = [*zip(ids, texts, strict=True), (ids[0], texts[0]), (None, texts[1])]
    known = [(k, t) for k, t in rows if k is not None]
    links = brute_links([t for _, t in known])
    sets = brute_jaccard([t for _, t in known])[0]
    pairs = [(known[a][0], known[b][0]) for a in range(len(known)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = components_of(70, pairs)
    want = sorted((k, len(s), n, comp[k] if s else k) for (k, _), s, n in zip(known, sets, links, strict=True))
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = [(r.doc_id, r.n_shingles, r.n_links, r.component_id) for r in jaccard.near_duplicates(d).collect()]
    assert sorted(r for r in got if r[0] is not None) == want and sum(r[0] is None for r in got) == 1
    # two texts of one document join what either links with
    a, b = "a b c d e f g h i j k l m n o p", "q r s t u v w x y z aa bb cc dd ee ff"
    d = spark.createDataFrame([(1, a), (1, b), (2, a + " z"), (3, b + " z")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.n_links, r.component_id) for r in jaccard.near_duplicates(d).collect()) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


@pytest.mark.parametrize("part", [2048, 9])
def test_links_of_a_large_family_are_counted(spark, monkeypatch, part):
    monkeypatch.setattr(jaccard, "PART_SETS", part)
    monkeypatch.setattr(jaccard, "FAN_IN", 2)
    rng = np.random.default_rng(part)
    base = [f"w{k}" for k in rng.integers(0, 500, 90)]
    texts = []
    for k in range(90):
        words = list(base)
        for at in rng.integers(0, 90, int(rng.integers(0, 4 if k % 3 else 2))):
            words[int(at)] = f"v{int(rng.integers(0, 5))}"
        texts.append(" ".join(words[: int(rng.integers(70, 91))]))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6)
    links, comp = brute_links(texts), brute_jaccard(texts)[1]
    got = {r.doc_id: (r.n_links, r.component_id) for r in jaccard.near_duplicates(d).collect()}
    assert got == {k: (links[k], comp[k]) for k in range(90)} and max(links) > 20


def test_degrees():
    rng, rule = np.random.default_rng(14), jaccard.Rule(75)
    for _ in range(30):
        base = rng.integers(0, 2**60, 40).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(40) < rng.choice([0.8, 0.97])], rng.integers(0, 2**60, int(rng.integers(1, 6))).astype(np.uint64)])) for _ in range(30)]
        weight, side = rng.integers(1, 4, 30), rng.random(30) < 0.5
        inside = lambda a, b: 175 * len(np.intersect1d(sets[a], sets[b])) >= 75 * (len(sets[a]) + len(sets[b]))
        for of in (None, side):
            want = [sum(weight[b] for b in range(30) if a != b and (of is None or of[a] != of[b]) and inside(a, b)) for a in range(30)]
            assert jaccard.degrees(rule, sets, weight, of).tolist() == want


def test_jaccard_on_nothing(spark):
    for rows in ([], [(1, None)], [(1, "a b c d e f")]):
        d = spark.createDataFrame(rows, "doc_id bigint, text string")
        assert [(r.doc_id, r.component_id) for r in jaccard.near_duplicates(d).collect()] == [(r[0], r[0]) for r in rows]


def test_leaders_leave_no_candidate_behind():
    rng = np.random.default_rng(9)
    rule = jaccard.Rule(75)
    for _ in range(50):
        part = np.zeros(30, jaccard.POSTING)
        part["doc"], part["n"], part["at"] = rng.permutation(100)[:30], np.sort(rng.integers(10, 30, 30)), rng.integers(0, 6, 30)
        a, b, rest = jaccard._leaders(rule, part)
        star = {frozenset(p) for p in zip(a.tolist(), b.tolist(), strict=True)}
        ok = {frozenset((x, y)) for x in range(30) for y in range(x) if jaccard._possible(rule, part["n"][x : x + 1], part["at"][x : x + 1], part["n"][y], part["at"][y])[0]}
        assert star <= ok
        assert star == ok or rest is not None and all(p <= set(rest.tolist()) for p in ok - star)


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 440)] + [(500, 500 + k) for k in range(1, 60)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = components_of(600, edges)
    assert got == {n: want[n] for e in edges if e[0] != e[1] for n in e}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


@pytest.mark.parametrize("part", [2048, 16])
def test_embedding_links(spark, monkeypatch, part):
    monkeypatch.setattr(neardup, "PART", part)
    rng = np.random.default_rng(part)
    centres = rng.normal(size=(12, 8))
    x = [(centres[k % 12] + rng.normal(size=8) * 0.18).tolist() for k in range(150)] + [rng.normal(size=8).tolist() for _ in range(40)]
    rows = [(k, v, k % 3) for k, v in enumerate(x)]
    rows += [(200, x[0], 0), (201, [2 * e for e in x[0]], 0), (202, x[0], None), (203, None, 0), (204, [0.0] * 8, 0), (205, [1.0, None] + [0.0] * 6, 0), (206, [float("nan")] * 8, 0), (207, [], 0), (208, [1.0, 2.0], 0), (209, x[3], 0), (209, x[3], 0), (None, x[0], 0)]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("rep", F.lit("clash")).repartition(3)
    got = neardup.near_duplicates(d, 0.93).collect()
    assert len(got) == len(rows)
    sound = [(k, np.array(v) / np.linalg.norm(v), y) for k, v, y in rows if k is not None and v and y is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(a, b) for i, (a, u, p) in enumerate(sound) for b, w, q in sound[:i] if p == q and len(u) == len(w) and u @ w >= 0.93]
    comp = components_of(300, links)
    count: Counter = Counter()
    for a, b in links:
        count[a] += 1
        count[b] += 1
    count[209] //= 2  # two rows share the id
    for r in got:
        if r.vec_id is None:
            assert r.n_links == 0 and r.component_id is None
        else:
            assert (r.n_links, r.component_id, r.kept) == (count[r.vec_id], comp[r.vec_id], comp[r.vec_id] == r.vec_id), r
    assert neardup.near_duplicates(d.limit(0), 0.93).collect() == []


def test_embeddings_with_a_repeated_id(spark):
    kind = "vec_id bigint, embedding array<double>, label int"
    rows = [(1, [1.0, 0.0], 5), (1, [0.0, 1.0], 5), (2, [1.0, 0.01], 5)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, kind), 0.93).collect())
    assert got == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    rng = np.random.default_rng(21)
    x = rng.normal(size=(12, 6))
    rows = [(int(i), (x[int(k)] + rng.normal(size=6) * 0.15).tolist() if rng.random() < 0.8 else x[int(k)].tolist(), int(y)) for i, k, y in zip(rng.integers(0, 40, 90), rng.integers(0, 12, 90), rng.integers(0, 2, 90), strict=True)]
    unit = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    links = [(a, b) for a in range(90) for b in range(a) if rows[a][2] == rows[b][2] and unit[a] @ unit[b] >= 0.93]
    comp = components_of(40, [(rows[a][0], rows[b][0]) for a, b in links])
    degree = Counter(k for p in links for k in p)
    want = sorted((i, degree[k], comp[i], comp[i] == i) for k, (i, _, _) in enumerate(rows))
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, kind).repartition(4), 0.93).collect())
    assert got == want


@pytest.mark.parametrize("centres", [1, 3, 256])
def test_cover_trees_cover(monkeypatch, centres):
    monkeypatch.setattr(neardup, "CENTRES", centres)
    rng = np.random.default_rng(centres)
    x = np.concatenate([rng.normal(size=(20, 4)) for _ in range(2)] + [rng.normal(size=4) + rng.normal(size=(60, 4)) * s for s in (0.02, 0.2)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = neardup.CoverTree(x)
    assert sorted(t.order.tolist()) == list(range(len(x)))
    for m in range(len(t.centre)):
        own = t.order[t.start[m] : t.end[m]]
        assert t.centre[m] in own and np.linalg.norm(x[own] - x[t.centre[m]], axis=1).max() <= t.radius[m] + 1e-7
    found: set = set()
    neardup.dual(t, t, 0.9, lambda i, j: found.update(frozenset(p) for p in zip(i.tolist(), j.tolist(), strict=True)))
    assert found == {frozenset((a, b)) for a in range(len(x)) for b in range(a) if x[a] @ x[b] >= 0.9}
