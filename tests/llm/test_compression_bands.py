"""Compression bands on random, repetitive and clean texts of every length class."""
import base64
import random

from tieout.llm import compression

SIZES = (300, 700, 1023, 1500, 3000, 4096, 6000, 20000, 100000)


def test_bands_of_every_class(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(400)]

    def noise(n):
        raw = base64.b64encode(rng.randbytes(n)).decode()
        return " ".join(raw[i:i + 12] for i in range(0, n, 12))[:n]

    def printable(n):
        return " ".join("".join(chr(rng.randint(33, 126)) for _ in range(9)) for _ in range(n // 10 + 1))[:n]

    def clean(n):
        return " ".join(rng.choices(words, [1 / (i + 3) for i in range(400)], k=n // 3))[:n]

    texts = [(kind, f(n)) for n in SIZES for kind, f in
             (("base64", noise), ("printable", printable), ("repetitive", lambda n: ("ab cd ef " * n)[:n]),
              ("clean", clean))]
    texts += [("tail", clean(4096) + " " + noise(3000))]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in compression.compression_rules(docs).collect()}
    wrong = [(kind, len(t), got[i]) for i, (kind, t) in enumerate(texts) if got[i].kept != (kind == "clean")]
    assert not wrong
    assert all(got[i].incompressible for i, (kind, _) in enumerate(texts) if kind in ("base64", "printable"))
    assert got[len(texts) - 1].bad_chunks and not got[len(texts) - 1].incompressible
