"""Fixed schemas and reserved values.  Nothing is ever inferred from JSON."""

from pyspark.sql import types as T

IGNORE = -100

# Fixed special tokens, in id order.
BOS, PAD, EOS, UNK, MASK = 0, 1, 2, 3, 4
BASE_SPECIALS = ["<s>", "<pad>", "</s>", "<unk>", "<mask>"]

TEXT_JSON = T.StructType([T.StructField("text", T.StringType())])
RAW_JSON = T.StructType([T.StructField("content", T.StringType())])
TAGGED_JSON = T.StructType(
    [
        T.StructField("tokens", T.ArrayType(T.StringType())),
        T.StructField("tags", T.ArrayType(T.IntegerType())),
    ]
)
FREQUENCY_CSV = T.StructType(
    [
        T.StructField("lang", T.StringType()),
        T.StructField("token_id", T.IntegerType()),
        T.StructField("freq", T.LongType()),
        T.StructField("rank", T.IntegerType()),
    ]
)


def pair_json(*columns: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


# Fixed tag names; the position is the tag id.
TAG_NAMES = [
    "O",
    "B-VAR", "I-VAR",
    "B-FUNC", "I-FUNC",
    "B-TYPE", "I-TYPE",
    "B-PRIM", "I-PRIM",
    "B-NUM", "I-NUM",
    "B-POIN", "I-POIN",
    "B-PDEC", "I-PDEC",
    "B-CONS", "I-CONS",
]


def lang_start(lang: str) -> str:
    """Start-of-sequence token of a language."""
    return f"<{lang.upper()}>"


def special_tokens(langs) -> list[tuple[int, str, bool]]:
    """(token_id, token, is_special) rows that open every vocabulary.

    The bare language word follows its start token: it must always be found,
    but stays an ordinary token.
    """
    rows = [(i, t, True) for i, t in enumerate(BASE_SPECIALS)]
    for lang in langs:
        rows.append((len(rows), lang_start(lang), True))
        rows.append((len(rows), lang, False))
    return rows
