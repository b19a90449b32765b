import pytest

#: Names that operators use inside; a table that has them too must not matter.
CLASHES = ["text_key", "key", "sha", "copies", "bucket", "slot", "shard", "record", "__id", "position", "spaced", "n_words", "labels", "score", "block", "ids", "n_tokens", "range", "task", "place", "length", "fp", "component_id", "host", "suffix", "best", "counts", "declared", "language", "kept", "rank"]


@pytest.fixture(scope="session")
def frame(spark):
    """(doc_id, text) rows as documents, with columns whose names clash."""

    def make(rows, clash=True):
        names = ["doc_id", "text", "lang", "source", "n_chars", *(CLASHES if clash else [])]
        held = [(i, t, "en", "s", 1, *([9] * len(CLASHES) if clash else [])) for i, t in rows]
        kinds = ["long", "string", "string", "string", "long", *(["int"] * len(CLASHES) if clash else [])]
        return spark.createDataFrame(held, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))

    return make


LONG = "lorem ipsum dolor sit amet consectetur " * 4000

#: Nulls, empty and long texts, ties, repeated rows, odd characters.
ODD = [
    (1, None),
    (2, ""),
    (3, "Hello world, it's a test.\nSecond  line"),
    (4, "Hello world, it's a test.\nSecond  line"),
    (4, "Hello world, it's a test.\nSecond  line"),
    (5, LONG),
    (6, "x" * 5000),
    (7, "é中\U0001f600    \x00 <|endoftext|> K İ ſ"),
    (None, "nobody's text"),
    (None, None),
    (None, "Hello world, it's a test.\nSecond  line"),
    (8, "   \t\n  "),
    (9, "Released under the MIT License."),
    (10, LONG + "end"),
    (11, "This work is licensed under the GNU General Public License, version 3."),
]


@pytest.fixture(scope="session")
def odd(frame):
    return frame(ODD)


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])
