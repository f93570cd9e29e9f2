import pytest
from pyspark.sql import functions as F

from duolex.operators import clean

NASTY = [
    "", "int a; // one\nint b;\n\n/* x\n y */c; // tail", "a // x\r\nb\r\n", "s = \"http://x\"; /* a // b */ z // t",
    "/* open\nnever closed", "'\\'' // c\n\"\\\"/*\" /* d */", "#define A 1 \\\n  + 2 // kept\nx // gone",
    "a b\u0085c // é\n\x1c\n d", "! c1\ncall foo()\n!\nx = 1 ! note\n!$omp do\n!dir$ x\n* old\nC old\n\n\n y='a!b'\n!",
    "x\t\n  \n\x0b\ny", "it's // fine\nisn't", "a/**/b/***/c/*/d*/e", "//\n//x", "c\ncd\n c\n*\n\n\n", " // \na",
    "'" + "x" * 20000 + "' // end", "\"a\\\nb\" // c", "a \ue000 // b \ue001 \ue002a '\ue000'",
]


# Hand-written scanners: the expected results, without any pattern matching.


def scan_c(code):
    out, i = "", 0
    while (j := code.find("//", i)) >= 0 and (k := code.find("\n", j)) >= 0:
        out, i = out + code[i:j] + "\n", k + 1
    code, out, i = out + code[i:], "", 0
    while (j := code.find("/*", i)) >= 0 and (k := code.find("*/", j + 2)) >= 0:
        out, i = out + code[i:j], k + 2
    lines = (out + code[i:]).splitlines()
    return "\n".join(x for x in lines if x and not x.isspace())


def scan_fortran(code):
    out, i = "", 0
    while i < len(code):
        bang = code[i] == "!" and i + 1 < len(code) and code[i + 1] != "$"
        column = code[i] in "cC*" and (i == 0 or code[i - 1] == "\n")
        if bang or column:
            end = code.find("\n", i + (2 if bang else 1))
            i = len(code) if end < 0 else end
        else:
            out, i = out + code[i], i + 1
    while "\n\n" in out:
        out = out.replace("\n\n", "\n")
    return out


def literal_end(code, i):
    """Index behind the literal or preprocessor line that starts at i, or None."""
    if code[i] in "'\"":
        k = i + 1
        while k < len(code) and code[k] != code[i]:
            k += 2 if code[k] == "\\" else 1
        return k + 1 if k < len(code) else None
    if code[i] == "#":  # to the end of the line; a continued line is ordinary text
        k = i
        while k < len(code) and code[k] not in "\r\n":
            k += 1
        return k
    return None


def scan_aware(code):
    out, i = "", 0
    while i < len(code):
        end = literal_end(code, i)
        if end is not None:
            out, i = out + code[i:end], end
        elif code.startswith("//", i):
            end = code.find("\n", i)
            out, i = out + " ", len(code) if end < 0 else end
        elif code.startswith("/*", i) and code.find("*/", i + 2) >= 0:
            out, i = out + " ", code.find("*/", i + 2) + 2
        else:
            out, i = out + code[i], i + 1
    return out


@pytest.fixture(scope="module")
def nasty(spark):
    return spark.createDataFrame(list(enumerate(NASTY)), "row_id int, text string")


def results(df, col="text"):
    return [r[col] for r in df.orderBy("row_id").collect()]


def test_c_comments(nasty):
    assert results(clean.remove_cpp_comments(nasty)) == [scan_c(t) for t in NASTY]


def test_fortran_comments(nasty):
    assert results(clean.remove_fortran_comments(nasty)) == [scan_fortran(t) for t in NASTY]


def test_string_aware(nasty):
    out = clean.remove_comments_string_aware(nasty, "text", "out")
    assert results(out, "out") == [scan_aware(t) for t in NASTY]


def test_golden(spark):
    def one(fn, text):
        return results(fn(spark.createDataFrame([(0, text)], "row_id int, text string")))[0]

    assert one(clean.strip_repo_prefix, "r/a | int x; ") == "int x;"
    assert one(clean.strip_repo_prefix, "a|b|c") == "b|c"
    assert one(clean.strip_repo_prefix, " none ") == " none "
    assert one(clean.strip_repo_prefix, "p|\t x  \x1f") == "x"
    assert one(clean.remove_cpp_comments, NASTY[1]) == "int a; \nint b;\nc; // tail"
    assert one(clean.remove_fortran_comments, NASTY[8]) == "\n!$omp do\n y='a\n!"


def test_long_white_space_stays_linear(spark):
    text = "a|x" + " " * 300_000 + "y" + " " * 300_000
    out = clean.strip_repo_prefix(spark.createDataFrame([(0, text)], "row_id int, text string"))
    assert results(out)[0] == text[2:].strip()


def test_cleaner_by_lang(spark):
    df = spark.createDataFrame([(0, "cpp", "a // b\nc"), (1, "fortran", "a ! b\nc")], "row_id int, lang string, text string")
    assert results(clean.apply_cleaner_by_lang(df)) == ["a \nc", "a \n"]


def test_map_batched_changes_rows(spark, corpus):
    out = clean.map_batched(corpus, lambda b: b.loc[b.index.repeat(2), ["row_id"]], "row_id bigint")
    assert out.count() == 120 and out.columns == ["row_id"]


def test_rename_drop(corpus):
    out = clean.rename_drop_columns(corpus, {"text": "cpp"}, ["lang"])
    assert out.columns == ["row_id", "cpp"]
    assert clean.rename_drop_columns(corpus, keep=["text"]).columns == ["text"]
    assert clean.add_lang_column(corpus.drop("lang"), "cuda").select(F.max("lang")).first()[0] == "cuda"
