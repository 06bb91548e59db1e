"""Import specifiers and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Extensions in the order in which they are tried.
EXTENSIONS = (".jsx", ".js", ".tsx", ".ts")


def parent(path: Column) -> Column:
    """The directory of a path, ``.`` for a bare name."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def normal(path: Column) -> Column:
    """A path without empty and ``.`` segments, each ``..`` taking the segment before it (none at the root)."""
    step = lambda done, part: (
        F.when((part == ".") | (part == ""), done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def is_relative(specifier: Column) -> Column:
    return specifier.startswith("./") | specifier.startswith("../")


def relative_import(specifier: Column, current_file: Column) -> Column:
    return normal(F.concat_ws("/", parent(current_file), specifier))


def base_url_import(specifier: Column, base_url: Column) -> Column:
    """A bare specifier under a project's base, null where it cannot be one."""
    bare = (F.coalesce(base_url, F.lit("")) != "") & (specifier != "") & ~is_relative(specifier) & ~specifier.startswith("@") & ~specifier.startswith("/")
    return F.when(bare, F.regexp_replace(F.regexp_replace(F.concat_ws("/", base_url, specifier), r"/(\./)+", "/"), r"/+$|^(\./)+", ""))


def alias_import(specifier: Column, aliases: Column) -> Column:
    """The specifier with its longest alias replaced; ``aliases`` is a map. Null where none matches."""
    hits = F.filter(F.map_entries(aliases), lambda e: (specifier == e["key"]) | specifier.startswith(F.concat(e["key"], F.lit("/"))))
    best = F.element_at(F.array_sort(hits, lambda a, b: F.length(b["key"]) - F.length(a["key"])), 1)
    return F.when(F.size(hits) > 0, F.concat(best["value"], F.substring(specifier, F.length(best["key"]) + 1, F.length(specifier))))


def import_base(specifier: Column, current_file: Column, aliases: Column, base_url: Column) -> Column:
    """Where an import points, without extension: relative, then alias, then base; null where it leaves the project."""
    ladder = F.when(is_relative(specifier), relative_import(specifier, current_file)).otherwise(F.coalesce(alias_import(specifier, aliases), base_url_import(specifier, base_url)))
    return F.when(F.coalesce(specifier, F.lit("")) != "", ladder)


def candidates(base: Column, symbol: Column | None = None) -> Column:
    """Files an import can mean, in order: one named after the symbol below it, then the extensions, then an index file."""
    own = [F.concat(base, F.lit("/"), symbol, F.lit(e)) for e in EXTENSIONS] if symbol is not None else []
    return F.array(*own, *[F.concat(base, F.lit(e)) for e in EXTENSIONS], *[F.concat(base, F.lit(f"/index{e}")) for e in EXTENSIONS])


def under(path: Column, prefix: Column | str) -> Column:
    """Whether a path is the prefix or lies below it."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def escapes(path: Column) -> Column:
    """Whether a path is absolute or leaves its root."""
    depth = F.aggregate(
        F.split(path, "/"), F.struct(F.lit(0).alias("at"), F.lit(False).alias("out")),
        lambda s, p: F.struct(
            F.when(p == "..", s["at"] - 1).when((p == ".") | (p == ""), s["at"]).otherwise(s["at"] + 1).alias("at"),
            (s["out"] | ((p == "..") & (s["at"] <= 0))).alias("out"),
        ),
    )
    return path.startswith("/") | depth["out"]


def flattened(path: Column) -> Column:
    """A path as one file name."""
    return F.translate(path, "/\\", "__")

