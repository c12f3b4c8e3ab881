"""Ids of chunks that are encoded together."""

from passlake.llm import packing as P


class Counting:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, inner):
        self.inner, self.n = inner, 0

    def encode_batch_fast(self, texts, **options):
        self.n += len(texts)
        return self.inner.encode_batch_fast(texts, **options)

    def encode(self, text, **options):
        return self.inner.encode(text, **options)


TEXTS = [
    "it's a 'test' isn't\nit? !!x y2 3,000 - -\nça été 中文 字​ <|endoftext|> <|endoftext|>", None, "", "\n", "a\nb\nc", "two  spaces", "tab\there", " lead", "trail ", "'s\n's 're\n12 ab12\n_x",
]


def plain(text):
    return P._bytes(P._load(P.tokenizer_path()).encode(text or "", add_special_tokens=False).ids)


def test_new_chunks_are_one_text():
    encoder = P.Encoder(P.tokenizer_path())
    encoder.tokenizer = Counting(encoder.tokenizer)
    texts = [*TEXTS, " ".join(f"w{k}" for k in range(5000))]
    assert encoder.encode(texts) == [plain(t) for t in texts]
    assert encoder.tokenizer.n < 10  # one for each chunk before
    assert encoder.encode(texts) == [plain(t) for t in texts]


def test_full_memory_and_a_feed_that_is_no_id(monkeypatch):
    monkeypatch.setattr(P, "CACHE_CHUNKS", 3)
    monkeypatch.setattr(P, "TOGETHER", 2)
    encoder = P.Encoder(P.tokenizer_path())
    for _ in range(2):
        assert encoder.encode(TEXTS) == [plain(t) for t in TEXTS]
    encoder = P.Encoder(P.tokenizer_path())
    encoder.feed = None
    assert encoder.encode(TEXTS) == [plain(t) for t in TEXTS]
