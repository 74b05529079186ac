"""Vocabulary files other than the default one: special tokens of their own, and kinds that are refused."""

from __future__ import annotations

import json

import numpy as np
import pytest

from ordinate.llm import bpe


def changed(tmp_path, **parts):
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    for k, v in parts.items():
        if isinstance(v, dict) and isinstance(spec.get(k), dict):
            spec[k] = spec[k] | v
        else:
            spec[k] = v
    path = tmp_path / "changed.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    return str(path)


def special(i, text, **flags):
    return {"id": i, "content": text, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} | flags


def test_special_tokens_of_any_text(tmp_path):
    from tokenizers import Tokenizer

    path = changed(tmp_path, added_tokens=[special(50256, "<|endoftext|>"), special(50257, "[END]"), special(50258, "[ENDING]")])
    ref, enc = Tokenizer.from_file(path), bpe.Encoder(path)
    for t in ["a [END] b", "[ENDING][END]<|endoftext|>", "no token here", "[EN", "x[ENDING", " [END]  <|endoftext|>\n"]:
        ids = ref.encode(t, add_special_tokens=False).ids
        mine = np.frombuffer(enc.encode(t), "<u4")
        assert mine.tolist() == ids and enc.decode(mine).decode() == ref.decode(ids, skip_special_tokens=False)


def test_other_kinds_are_refused(tmp_path):
    import public_tokenizers

    with pytest.raises(ValueError, match="normalizer"):
        bpe.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for parts in ({"pre_tokenizer": {"add_prefix_space": True}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {"ignore_merges": True}}, {"decoder": None}, {"added_tokens": [special(50256, "<|endoftext|>", lstrip=True)]}):
        with pytest.raises(ValueError):
            bpe.Encoder(changed(tmp_path, **parts))
