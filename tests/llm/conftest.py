import pytest

LONG = "word " * 60_000
ROWS = [
    (1, None, "en"),
    (2, "", "en"),
    (3, " \n\t ", None),
    (4, "one", "en"),
    (5, LONG, "fr"),
    (6, "The same text twice, with some words more.", "en"),
    (6, "The same text twice, with some words more.", "en"),
    (7, "The same text twice, with some words more.", "de"),
    (8, "é😀 <|endoftext|> ▁ \x00 \u0085 x y  z<s>", "en"),
    (None, "a row without an id", "en"),
]
CLASH = ["ids", "start", "length", "bucket", "f", "component_id", "spans", "words", "stratum", "kept", "n_words", "canonical", "license", "host", "path", "frames", "h", "pos", "first", "source", "offset", "sequence_id"]
# names that the operators give their own columns
CLASH += ["in0", "in1", "base", "redacted", "id", "rows", "text_sha256", "own_sha256", "class", "x", "doc", "cuts", "kept_text", "limit_stratum", "limit_symbols", "q_n_words", "q_stratum", "q_kept", "base_failed", "n_lines", "chunk", "n", "plain", "found", "h", "salt", "part", "docs", "places", "words", "ranges", "names", "media", "n_frames", "colours", "known_sha256", "url", "html", "block"]
CLASH = list(dict.fromkeys(CLASH))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with the operators' own names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH if c != "source")
    rows = [(i, t, lang, "s", None if t is None else len(t), *["?"] * (len(CLASH) - 1)) for i, t, lang in ROWS]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")


@pytest.fixture(scope="session")
def data():
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("the driver's tables aren't here")
    return folder
