"""Words of a vocabulary that drops white space are split once, however often they are met."""

import public_tokenizers

from scorewright.llm import tokens


def test_a_known_word_is_not_split_again(monkeypatch):
    split, real = [], tokens._PLAIN

    class Counted:
        def findall(self, text):
            split.append(text)
            return real.findall(text)

    monkeypatch.setattr(tokens, "_PLAIN", Counted())
    encoder = tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), spaced=False, limit=50)
    text = "Don't stop, it's 12² cafés.\xa0don't\tstop,\r\n _x_ " * 30
    ids = encoder.encode([text, text])
    assert len(split) == len(set(text.lower().split()))
    whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert list(memoryview(ids[0]).cast("I")) == whole and ids[0] == ids[1]
    for i in range(200):  # a full table is emptied
        encoder.encode([f"word{i} other"])
    assert len(encoder.words) <= 50
