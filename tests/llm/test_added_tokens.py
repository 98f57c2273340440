"""Added tokens of the vocabulary inside a text, as the library's plain call has them."""

import public_tokenizers as P
from tokenizers import Tokenizer

from storelens.llm.token_files import WordEncoder


def test_added_tokens_in_a_text_get_their_ids():
    library, words = Tokenizer.from_file(P.path("byte_bpe_50k.json")), WordEncoder(P.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endoftext| >", "plain text, no tokens", "", "<|endof text|>"]
    got = [ids.tolist() for ids in words.encode(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert 50256 in got[0]
