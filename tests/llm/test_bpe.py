import public_tokenizers
from quillwork.llm import bpe


def test_words_met_again_are_not_encoded_again(monkeypatch):
    """Memory turns over by generations: a word in use stays known, and what is held is bounded."""
    monkeypatch.setattr(bpe, "MEMORY", 8)
    codec = bpe.Codec(bpe.model_bytes(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))), public_tokenizers.PATTERN)
    model, asked = codec.model, []

    class Counting:
        id_to_piece = staticmethod(model.id_to_piece)

        def encode(self, words, **more):
            asked.extend(words)
            return model.encode(words, **more)

    codec.model = Counting()
    for i in range(60):
        text = f"often é #{i}\n rare{i}"
        n, _, decoded = codec.digest(text)
        ids = codec.encode(text)
        assert n == len(ids) and codec.bytes_of(ids) == text.encode() and len(codec.pieces) + len(codec.older) <= 16
        assert decoded == bpe.hashlib.sha256(text.encode()).hexdigest()
    assert asked.count("often") == 1
