"""Inputs that tables rarely have, for the operators' tests."""

import random

SF = "/root/testdata/sf0.001"

#: Names that the operators use inside, as extra columns of the input.
CLASHING = ("size", "target", "row", "block", "kind", "shard", "th", "bands", "h1", "doc", "dh", "row_key", "start",
            "root", "node", "links", "score", "n_words", "kept_text", "source_no", "bucket", "x", "held_out", "label", "__a", "__b", "__th", "__n", "__k0", "__K1")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
    f"{c} string" for c in CLASHING)


def odd_rows() -> list[tuple]:
    """Nulls, empty and long texts, ties, repeated rows, near copies, frequent lines, odd characters."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghiéß") for _ in range(rng.randint(2, 9))) for _ in range(3000)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))
    line = "  A line that many documents share, with É and a tab\t"
    rows = [(1, None, "en", "a"), (2, "", "en", "b"), (None, "no id " + prose(50), "en", None), (3, " \t\n\x0b ", None, "a"),
            (4, "one two", "en", "a"), (5, "one two", "en", "a"), (6, "ONE two three four", "en", "")]
    copy = prose(80)
    rows += [(10, copy, "en", "a"), (10, copy, "en", "a"), (11, copy, "de", "b"), (12, copy.replace(" ", "\n", 5), "en", "a")]
    base = prose(120).split(" ")
    for i in range(13, 33):
        near = list(base)
        near[(i * 7) % 120] = f"edit{i}"
        rows.append((i, " ".join(near), "en", "a" if i % 3 else None))
    for i in range(40, 48):
        rows.append((i, f"{prose(30)}\n{line if i % 2 else line.strip().upper()}\n{prose(10)}\n{line}", "en", "b"))
    rows.append((50, prose(30000), "en", "long"))
    rows.append((51, "x" * 200000, "en", "long"))
    rows.append((52, ("again and again the same eight words stand here " * 300).strip(), "en", "c"))
    rows.append((53, "mail a@b.cc@d.e f@g.h_i@j.k 1.2.3.4.5.6.7.8 999.1.1.1 +1 (223) 555-1234x 4111 1111-1111 1111 "
                     "password=32bb02aa3b580bf8ab and 0000.1.2.3 é token = \"0641917ea4e9feb9cda83477b57ac265\"", "en", "c"))
    rows.append((54, "Licensed under CC BY-NC 4.0 cc by cc by ALL rights\nreserved general public license", "en", "c"))
    rows += [(60 + i, prose(rng.randint(1, 200)), rng.choice(["en", "de"]), rng.choice("abc")) for i in range(40)]
    return [(d, t, g, s, None if t is None else len(t), *("clash" for _ in CLASHING)) for d, t, g, s in rows]
