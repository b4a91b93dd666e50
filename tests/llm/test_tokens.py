import random

import numpy as np
import pytest
import tiktoken

from bundlewright.llm import chat, pretokens, token_counts, transducer
from bundlewright.llm.common import TOKENIZERS

LETTERS = list("ab'sstmdrevelEL  \n\t\r12½٣.,!?'’éßñ日本  😀_")


@pytest.fixture(scope="module")
def known():
    return tiktoken.Encoding("own", pat_str=pretokens.PATTERN, mergeable_ranks=pretokens.ranks(TOKENIZERS), special_tokens={})


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    some = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    return [*some, "'seven", "it's", "' 's", "x 's", "''s", "a'r", "  ", "", "\n 'd", "a" * 3000, " " * 3000 + "x", "ab" * 4000, "!" * 2500, "é" * 2500]


def packed(texts):
    each = [t.encode() for t in texts]
    return np.frombuffer(b"".join(each), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(e) for e in each])]).astype(np.int64)


def test_pretokens_of_columns_are_those_of_the_pattern(texts):
    data, offsets = packed(texts)
    start, end, first = pretokens.find(data, offsets)
    raw = data.tobytes()
    for i, t in enumerate(texts):
        assert [raw[start[j] : end[j]].decode() for j in range(first[i], first[i + 1])] == pretokens._EXACT.findall(t)


def test_proved_strings_are_one_token(known):
    proved = sorted(token_counts.proved_whole())
    assert len(proved) > 45_000 and all(len(known.encode_ordinary(t)) == 1 for t in proved[::50])


def test_counts(spark, known, texts):
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(-1, None, "x"), (0, texts[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = token_counts.count_tokens(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_tokens == (None if r.doc_id < 0 else len(known.encode_ordinary(texts[r.doc_id])))
    assert token_counts.count_tokens(df.limit(0)).count() == 0


def test_memory_starts_anew(known, texts, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 100)
    monkeypatch.setattr(transducer, "REMEMBERED", 100)
    lengths, pieces = token_counts.Lengths(TOKENIZERS), transducer.Pieces(TOKENIZERS)
    for at in range(0, 900, 300):
        data, offsets = packed(texts[at : at + 300])
        start, end, first = pretokens.find(data, offsets)
        each = np.concatenate([[0], np.cumsum(lengths.of(data, start, end))])[first]
        ids, places = pieces.encode(data, start, end)
        places = places[first]
        for i, t in enumerate(texts[at : at + 300]):
            want = known.encode_ordinary(t)
            assert each[i + 1] - each[i] == len(want) and ids[places[i] : places[i + 1]].tolist() == want


def test_blocks_of_any_size_encode_alike(known, texts):
    some = texts[-14:] + texts[:300] + ["x " + "é" * 5000 + " y", "'" * 3000 + "s", "  " * 2000 + "'re", "日本" * 1500 + "12"]
    data, offsets = packed(some)
    for block in (4, 7, 61, 1000, 3000, 1 << 19):
        ids, first = transducer.encode_texts(data, offsets, block=block)
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [known.encode_ordinary(t) for t in some]


def test_encoder_holds_little():
    encoder, most = transducer.Encoder(), 0
    rng = random.Random(5)
    for k in range(400):
        part = rng.choice(["some words, ", "a" * 5000, "      " * 900, "!" * 5000, "12 "]).encode()
        encoder.feed(np.frombuffer(part, dtype=np.uint8), np.array([0, len(part)]), True)
        most = max(most, len(encoder.held) + (len(encoder.run.held) if encoder.run else 0))
    assert most < 2 * encoder.LONG + 3 * encoder.vocabulary.lookahead


def test_encoding_and_decoding_tables(spark, known, texts):
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(-1, None, "x"), (0, texts[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    encoded = transducer.encode_table(df)
    for r in encoded.collect():
        if r.doc_id < 0:
            assert r.token_ids is None and r.n_tokens is None and r.restored is None
        else:
            assert r.token_ids == known.encode_ordinary(texts[r.doc_id]) and r.restored and r.n_tokens == len(r.token_ids)
    back = transducer.decode_table(encoded).collect()
    assert len(back) == len(rows) and {r.doc_id: r.text for r in back} == {i: t for i, t, _ in rows}
    assert transducer.encode_table(df.limit(0)).count() == 0 and transducer.decode_table(encoded.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, [64, None, 64]), (2, [-1]), (3, [10**6, 64]), (4, []), (5, None)], "doc_id long, token_ids array<int>")
    assert {r.doc_id: r.text for r in transducer.decode_table(odd).collect()} == {1: "a\ufffda", 2: "\ufffd", 3: "\ufffda", 4: "", 5: None}


def test_texts_of_over_two_megabytes(spark, known):
    rng = random.Random(6)
    words = [rng.choice(["the", "'re", "12", "naïve", "日本", "a" * 70, "\n\n", "…"]) for _ in range(400_000)]
    rows = [(1, " ".join(words)), (2, "ab" * 1_200_000), (3, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {1: known.encode_ordinary(rows[0][1]), 3: known.encode_ordinary("short")}
    got = {r.doc_id: r for r in transducer.encode_table(df).collect()}
    counted = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df).collect()}
    assert all(got[k].token_ids == w and counted[k] == len(w) for k, w in want.items()) and all(r.restored for r in got.values())
    assert counted[2] == got[2].n_tokens and set(got[2].token_ids) == set(known.encode_ordinary("ab" * 100))


def test_lookahead_is_sufficient():
    ids = transducer.vocabulary(TOKENIZERS)
    rng = random.Random(1)
    for _ in range(300):
        text = bytes(rng.choice(b"abcdeinorst") for _ in range(rng.randint(1, 400)))
        machine = transducer.PieceTransducer(ids.pair_rank, ids.lookahead)
        out, at = [], 0
        while at < len(text):
            n = rng.randint(1, 60)
            out += machine.feed(text[at : at + n])
            at += n
        assert [*out, *machine.finish()] == pretokens.merge(text, ids.pair_rank)


def test_utf8_machine():
    raw = "aé日😀".encode() + b"\xf0\x9f\x98" + b"\xff" + "z".encode() + b"\xe6"
    for size in (1, 2, 3, 5):
        machine = transducer.Utf8Machine()
        parts = [machine.feed(raw[i : i + size]) for i in range(0, len(raw), size)]
        assert "".join([*parts, machine.finish()]) == raw.decode("utf-8", "replace")


def test_chat_masks_against_all_pairs_of_spans(spark, known):
    rng = random.Random(4)
    rows = []
    for c in range(30):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice([None, "", " lead", "é\n", "x<|im_end|>\n", "it's 12 words, or so"]), 1))
    rows += [(None, 0, "user", "lost", 1), (99, None, "assistant", "no number", 1), (99, 0, "user", "later", 1), (99, 0, "user", "later", 1)]
    rows += [(100, 0, "user", "y" * 10, 1), (100, 1, "assistant", "a long text " * 200_000, 1), (100, 2, "user", "z", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_tokens int")
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert set(got) == {r[0] for r in rows} - {None}
    for c, r in got.items():
        turns = sorted(((-1 if t is None else t, role or "unknown", text or "") for k, t, role, text, _ in rows if k == c))
        ids, ends, inside, place = [], [], [], 0
        for _, role, text in turns:
            own = [(chat.OPEN_ID, b"<|im_start|>", False)]
            head, seen = (role + "\n").encode(), 0
            for i in known.encode_ordinary(f"{role}\n{text}"):
                raw = known.decode_single_token_bytes(i)
                own.append((i, raw, seen >= len(head)))
                seen += len(raw)
            own += [(chat.CLOSE_ID, b"<|im_end|>", True), (198, b"\n", False)]
            mine = [k for k, x in enumerate(own) if x[2]]
            n = len(inside)
            assert r.turn_first[place] == n + mine[0] and r.turn_last[place] == n + mine[-1] + 1
            ids += [x[0] for x in own]
            inside += [int(x[2] and role == "assistant") for x in own]
            place += 1
        assert r.token_ids == ids and r.loss_mask == inside and (r.n_turns, r.n_tokens, r.n_trained) == (len(turns), len(ids), sum(inside))
    assert chat.format_chats(df.limit(0)).count() == 0
