"""File extensions, languages and kinds of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.functions.text import extension_of

#: Fixed values: (extension, language, display name, indexed as code, scanned).
LANGUAGES = (
    (".ts", "typescript", "TypeScript", True, True),
    (".tsx", "typescript", "TypeScript", True, True),
    (".js", "javascript", "JavaScript", True, True),
    (".jsx", "javascript", "JavaScript", True, True),
    (".mjs", "javascript", "JavaScript", True, True),
    (".py", "python", "Python", True, True),
    (".pyi", "python", "Python", False, False),
    (".go", "go", "Go", True, True),
    (".rs", "rust", "Rust", True, True),
    (".java", "java", "Java", True, True),
    (".c", "c", "C", True, True),
    (".h", "c", "C", True, True),
    (".cpp", "cpp", "C++", True, True),
    (".cc", "cpp", "C++", False, False),
    (".cxx", "cpp", "C++", False, False),
    (".hpp", "cpp", "C++", True, True),
    (".ino", "cpp", "C++", True, True),
    (".md", "markdown", "Markdown", False, True),
)
ALWAYS_SCANNED = ("platformio.ini",)


def dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LANGUAGES), "extension string, language string, display_name string, is_code boolean, scanned boolean")


def language_of(path: Column) -> Column:
    """The language of a path's extension, 'unknown' for others: a literal map, so no join."""
    pairs = [F.lit(x) for ext, language, *_ in LANGUAGES for x in (ext, language)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension_of(path)), F.lit("unknown"))


def scanned_extensions() -> list[str]:
    return [ext for ext, *_, scanned in LANGUAGES if scanned]


def is_scanned(path: Column, extensions: list[str] | None = None) -> Column:
    """By extension, or one of the file names that always pass; an explicit list of extensions replaces the default."""
    wanted = extensions if extensions is not None else scanned_extensions()
    name = F.element_at(F.split(path, "/"), -1)
    return extension_of(path).isin(*wanted) | name.isin(*ALWAYS_SCANNED)


def kind_of(path: Column) -> Column:
    """How a file is indexed: markdown, code, ini or unsupported."""
    code = [ext for ext, _, _, is_code, _ in LANGUAGES if is_code]
    name = F.element_at(F.split(path, "/"), -1)
    return (
        F.when(name.isin(*ALWAYS_SCANNED), "ini").when(extension_of(path) == ".md", "markdown").when(extension_of(path).isin(*code), "code").otherwise("unsupported")
    )


def is_scanned_path(path: str, extensions: list[str] | None = None) -> bool:
    """is_scanned() of one path, for listing a tree."""
    wanted = extensions if extensions is not None else scanned_extensions()
    name = path.rpartition("/")[2]
    stem, dot, ext = name.rpartition(".")
    return name in ALWAYS_SCANNED or (bool(dot) and f".{ext}".lower() in wanted)
