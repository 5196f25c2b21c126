import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the of and thin ering tion blewh onere anor eahe stion lyble athor wereing houti sedan onti".split()


def prose(seed, n):
    """n words that repeat little beyond chance."""
    out, x = [], seed * 2654435761 + 12345
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(WORDS[(x >> 33) % len(WORDS)] + WORDS[(x >> 45) % len(WORDS)])
    return " ".join(out)


def corpus():
    """Rows with nulls, empty and very long texts, copies, near copies, shared passages and repeated rows."""
    rows = [(i, prose(i, 40 + 7 * i), "en", f"src{i % 4}") for i in range(30)]
    shared = prose(777, 60)
    rows += [(100 + i, f"{prose(50 + i, 30)} {shared} {prose(80 + i, 30)}", "de", "src1") for i in range(6)]
    rows += [(200 + i, "  " * i + prose(3, 61).replace(" ", "\n" if i % 2 else "\t"), "en", "src0") for i in range(5)]
    near = prose(900, 300).split()
    rows += [(300 + i, " ".join([*near[:i], f"edit{i}", *near[i + 1 :]]), "fr", "src2") for i in range(8)]
    rows += [(400, None, None, None), (401, "", "en", "src0"), (402, " \t\n", "en", None), (403, "one", "en", "src3"), (404, "a b", "en", "src3")]
    rows += [(500, prose(1000, 30_000), "en", "src9"), (501, "x" * 30_000, "en", "src9"), (502, "Ünïcödé ♥ 𝒳 " * 50, "fr", "src9")]
    rows += [(600, prose(600, 25), "en", "src0"), (600, prose(600, 25), "en", "src0"), (None, prose(601, 25), "en", "src0"), (None, None, None, None)]
    return [(i, t, g, s, len(t) if t is not None else None) for i, t, g, s in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def unique(docs):
    """The rows with ids of their own."""
    return docs.filter("doc_id is not null and doc_id <> 600").cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def label_rows(spark):
    return spark.createDataFrame([(i, i % 3 != 0, i % 2) for i in range(30)], "doc_id long, q boolean, toxic int").selectExpr("doc_id", "int(q) quality", "toxic")


@pytest.fixture(scope="session")
def clashing(docs):
    """The rows with more columns, named like those the operators make."""
    names = "score size bucket rank part row key place text_sha256 fp id path p blob copies k_id".split()
    return docs.selectExpr("*", *[f"'clash' as {n}" for n in names])
