import pytest

from stowage.functions import blake3

# Published test vectors: bytes 0, 1, ..., 250, 0, 1, ... of the given length.
VECTORS = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
    1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
    2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a",
}


def content(n):
    return bytes(i % 251 for i in range(n))


@pytest.mark.parametrize("n", VECTORS)
def test_vectors(n):
    assert blake3.digest(content(n)) == VECTORS[n]


def test_short_text():
    assert blake3.digest(b"abc") == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"


def test_together_as_alone(spark):
    many = [content(n) for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 3000, 3072, 3073, 7168, 7169, 40_000)]
    assert blake3.digests(many) == [blake3.digest(c) for c in many]
    assert len(set(blake3.digests(many))) == len(many)
    df = spark.createDataFrame([(bytearray(c),) for c in many] + [(None,)], "c binary")
    assert [r[0] for r in df.select(blake3.blake3("c")).collect()] == blake3.digests(many) + [None]
