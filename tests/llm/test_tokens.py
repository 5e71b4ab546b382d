"""Added tokens of the vocabulary file inside texts."""

import numpy as np

from parindex.llm import tokens


def test_added_tokens_have_their_own_id():
    from tokenizers import Tokenizer
    path = tokens.default_path()
    t, mark = Tokenizer.from_file(path), "<|endoftext|>"
    for text in ("a <|endoftext|> b", mark, mark * 3, f" {mark}\n\n{mark}x", f"one{mark}two  {mark}", f"<|{mark}|>",
                 "<|endoftext|", f"\x1c {mark} \x1f", f"it's {mark}'s", f"été  {mark} \t"):
        assert np.frombuffer(tokens.encode(text, path), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
