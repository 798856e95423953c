"""Token ids of single pieces that are encoded together."""

import numpy as np

from supplylens.llm import token_store


def test_plain_words_need_no_special_token(monkeypatch):
    encoder, apart = token_store.PieceEncoder(token_store.tokenizer_definition()), []
    whole = encoder._encode_apart
    monkeypatch.setattr(encoder, "_encode_apart", lambda pieces: apart.extend(pieces) or whole(pieces))
    plain = ["word", "Word,", "élève...", "ÀÖØöøįıſ", "ªµº", "end>", "x|y", "a_b", "a__", "zzzqxj#", "A", "ß!"] + [f"w{chr(97 + i % 26)}" * i for i in range(1, 1500)]
    odd = ["İx", "İ.", "don't", "x'", "'s", "a<b", "</w>", "a</w>", "<|endoftext|>", "1a", "a1", "½", "中文.", "ꟲa", "ꟲ.", "é", "́", "a‍", "\x00", "…", "ǅa", "K"]
    texts = [" ".join(plain), "\n".join(odd), None, "", " \t", " ".join(p + q for p in odd for q in odd)]
    got = encoder.encode([t if t is None else t.encode() for t in texts])
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(g, dtype="<u4").tolist() for g in got] == want
    assert not {b"word", b"word,", "élève...".encode(), b"zzzqxj#"} & set(apart)


def test_runs_that_do_not_add_up_are_encoded_apart():
    encoder = token_store.PieceEncoder(token_store.tokenizer_definition())
    assert encoder._encode_runs(["word", "two1"], [1, 1]) is None
    assert encoder._encode_runs(["word", "two,"], [1, 2]) == encoder._encode_apart([b"word", b"two,"])
