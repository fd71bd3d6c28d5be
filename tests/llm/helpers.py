"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, _key string, fp string"

ENGLISH = "the shape of the thing and the other thing with that of this and on for it"
FRENCH = "le chat est dans la maison et il ne veut pas que les autres soient avec nous"


def awkward(spark, extra=()):
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, "   \n\t ", "en", "a", 6),
        (4, ENGLISH, "en", "a", 1),
        (5, ENGLISH, "en", "b", 1),
        (6, ENGLISH, "en", "b", 1),
        (6, ENGLISH, "en", "b", 1),
        (7, (ENGLISH + " ") * 400, "en", "b", 1),
        (8, FRENCH + "é€\U0001f600 deux", "fr", None, 1),
        (9, "12 34 !!", None, "c", 1),
        (None, FRENCH, "fr", "c", 1),
        (10, "One  two\n three   four <|endoftext|> five's  ", "en", "c", 1),
        *extra,
    ]
    return spark.createDataFrame([(*r, 7, 8, "k", "f") for r in rows], DOCS)
