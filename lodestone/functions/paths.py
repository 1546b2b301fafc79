"""Column functions over paths and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by language; JavaScript files count as typescript.
EXTENSIONS = {"typescript": (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"), "python": (".py", ".pyi"), "go": (".go",), "rust": (".rs",)}
SUPPORTED = tuple(e for own in EXTENSIONS.values() for e in own)
LANGUAGES = ("typescript", "javascript", "python", "go", "rust")


def language(path: Column) -> Column:
    """The language of a path by suffix, in any case; null if unsupported."""
    out = F.lit(None).cast("string")
    for name, own in reversed(EXTENSIONS.items()):
        rule = "|".join(e[1:] for e in own)
        out = F.when(F.lower(path).rlike(rf"\.({rule})$"), name).otherwise(out)
    return out


def extension(path: Column) -> Column:
    """From the last dot on, case kept."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def short(path: Column, segments: int = 2, mark: str = "") -> Column:
    """The last segments of a longer path, behind a mark."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > segments, F.concat(F.lit(mark), F.array_join(F.slice(parts, -segments, segments), "/"))).otherwise(path)


def normal(path: Column) -> Column:
    """A path without `.`, `..` and empty segments; `..` at the root goes."""
    step = lambda done, s: F.when(s.isin("", "."), done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))
    folded = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    plain = F.rtrim(F.regexp_replace(path, r"(?<![^/])\.?(?:/|\z)", ""), F.lit("/"))  # only `..` needs the fold
    return F.when(path.rlike(r"(?<![^/])\.\.(?:/|\z)"), folded).otherwise(plain)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def owner(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"github\.com[/:]([^/]+)/([^/.]+)", 1), F.lit(""))


def repository(url: Column) -> Column:
    """The repository's name; it stops at the first dot."""
    return F.nullif(F.regexp_extract(url, r"github\.com[/:]([^/]+)/([^/.]+)", 2), F.lit(""))


def repository_id(url: Column) -> Column:
    return F.concat(F.lit("github:"), owner(url), F.lit("/"), repository(url))


def slug(owner_: Column, name: Column) -> Column:
    return F.lower(F.concat_ws("--", owner_, name))


def parse_slug(text: Column) -> Column:
    """(owner, name) of a slug of exactly two parts, else null."""
    parts = F.split(text, "--")
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("owner"), parts[1].alias("name")))


def citation_url(url: Column, branch: Column, path: Column, start: Column, end: Column) -> Column:
    """Where the lines of a citation are shown; the path and lines alone without a repository."""
    lines = F.concat(F.lit("#L"), start.cast("string"), F.lit("-L"), end.cast("string"))
    return F.when(url.isNotNull(), F.concat(url, F.lit("/blob/"), branch, F.lit("/"), path, lines)).otherwise(F.concat(path, lines))


def trim(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")
