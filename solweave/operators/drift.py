"""Files whose fields drift: a report of each change, and one consistent table."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solweave.functions import trees
from solweave.functions.carry import before
from solweave.staging import stage

#: Files of a feed that are compared in one task; a longer feed is spread over several.
FILES = 1024
#: Content of two names at least this alike (0..1) is the same content.
ALIKE = 0.35
#: Names that share more than this part of the files of the rarer one are two fields, however alike.
TOGETHER = 0.02
#: Content this alike makes names one field without a rename between them.
SAME = 0.6

KINDS = {"text": "text", "whole": "whole number", "real": "real number", "bool": "true/false", "list": "list", "object": "object"}
SEP = "\x1f"


_KIND = {type(None): None, bool: "bool", str: "text", int: "whole", float: "real", list: "list", dict: "object"}
_NUMBER, _LOWER, _UPPER, _WORD = (re.compile(p) for p in (r"\d+", r"[a-z]+", r"[A-Z]+", r"[^\W_]+"))


def kind_of(v: object) -> str | None:
    return _KIND.get(type(v), "object")


def traits(v: object, prefix: str = "") -> list[tuple[str, str]]:
    """What a value looks like, as (family, trait): shape and words of texts, size and digits of numbers, the same of members."""
    kind = _KIND.get(type(v), "object")
    if kind == "text":
        plain = _NUMBER.sub("9", v)
        shape = _LOWER.sub("a", _UPPER.sub("A", plain))
        # Running text is known by the shapes of its words, not by how many follow each other.
        shape = " ".join(sorted(set(shape.split()))) if shape.count(" ") > 2 else shape
        return [(prefix + "shape", shape)] + [(prefix + "word", w) for w in _WORD.findall(plain)]
    if kind == "real":
        size = "0" if v == 0 else str(math.floor(math.log10(abs(v)))) if math.isfinite(v) else "inf"
        return [(prefix + "size", size), (prefix + "digit", str(min(9, len(repr(v).partition(".")[2]))))]
    if kind == "whole":
        size = "0" if v == 0 else str(math.floor(math.log10(abs(v))))
        return [(prefix + "size", size), (prefix + "digit", str(v) if abs(v) < 10 else "-")]
    if kind == "list":
        return [(prefix + "length", str(len(v)))] + [t for e in v for t in traits(e, prefix + "member ")]
    if kind == "object":
        return [(prefix + "width", str(len(v)))] + [t for e in v.values() for t in traits(e, prefix + "member ")]
    return [] if kind is None else [(prefix + "bool", "bool")]


def _paths(v: object, path: str) -> Iterator[tuple[str, str | None]]:
    yield path, kind_of(v)
    if isinstance(v, dict):
        for k, x in v.items():
            yield from _paths(x, f"{path}{SEP}{k}")
    elif isinstance(v, list):
        for x in v:
            yield from _paths(x, f"{path}{SEP}[]")


def _members(v: object, path: str) -> Iterator[tuple[str, object]]:
    """The members of objects below a field, by their paths."""
    if isinstance(v, dict):
        for k, x in v.items():
            yield f"{path}{SEP}{k}", x
            yield from _members(x, f"{path}{SEP}{k}")


def read_object(body: str | None) -> dict | None:
    """The JSON object of a line; None for a line that is cut off or holds none."""
    try:
        got = json.loads(body) if body else None
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


#: Different texts and figures that a task counts before it hands them on.
HELD = 200_000


class _Looks:
    """Counts of what the values of each name and kind look like; texts, lists and objects are counted first and taken apart once each."""

    def __init__(self) -> None:
        self.seen: dict[tuple[str, str], dict[str, list]] = {}
        self.rest: dict[tuple[str, str], dict[tuple[str, str], int]] = {}
        self.held = 0

    def add(self, name: str, own: str | None, v: object) -> None:
        if own == "text" or own == "list" or own == "object":
            key = v if own == "text" else repr(v)
            seen = self.seen.setdefault((name, own), {})
            if key in seen:
                seen[key][0] += 1
            else:
                seen[key] = [1, v]
                self.held += 1
        elif own is not None:
            rest = self.rest.setdefault((name, own), {})
            for t in traits(v):
                rest[t] = rest.get(t, 0) + 1

    def rows(self) -> Iterator[tuple]:
        for key, seen in self.seen.items():
            rest = self.rest.setdefault(key, {})
            for n, v in seen.values():
                for t in traits(v):
                    rest[t] = rest.get(t, 0) + n
        for (name, own), rest in self.rest.items():
            for (family, trait), n in rest.items():
                yield None, None, None, None, None, own, name, family, trait, n
        self.__init__()


def _scan(feed: str, seq: str, file_id: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per thousand lines of a file, with its fields (path, kind) and the counts they come from; and counts of traits of each name and kind.

    Lines come in the order of file, thousand and line; a line that occurs again is passed over.
    """
    names = ["feed", "seq", "file_id", "fields", "counts", "kind", "name", "family", "trait", "n"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _SCAN_TYPES, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looks, group, last, found = _Looks(), None, None, {}

        def packed() -> tuple:
            """The row of the thousand that is complete."""
            fields = [(path, _settled(kinds)) for path, kinds in found.items()]
            counts = [(path, kind, n) for path, kinds in found.items() for kind, n in kinds.items()]
            return (*group[:3], fields, counts, None, None, None, None, None)

        for b in batches:
            out = []
            for f, s, i, t, n, body in zip(*(b[c].to_pylist() for c in (feed, seq, file_id, "__thousand", "__line", "__body")), strict=True):
                now = (f, s, i, t)
                if now != group:
                    if found:
                        out.append(packed())
                    group, last, found = now, None, {}
                if n == last:
                    continue
                last, line = n, read_object(body)
                if line is None:
                    continue
                found.setdefault("", {None: 0})[None] += 1
                for name, v in line.items():
                    own = _KIND.get(type(v), "object")
                    kinds = found.setdefault(name, {})
                    kinds[own] = kinds.get(own, 0) + 1
                    looks.add(name, own, v)
                    if own == "list" or own == "object":
                        for path, kind in set(_paths(v, name)) - {(name, own)}:
                            kinds = found.setdefault(path, {})
                            kinds[kind] = kinds.get(kind, 0) + 1
                        for path, x in _members(v, name):
                            looks.add(path, kind_of(x), x)
            if looks.held > HELD:
                out += looks.rows()
            yield batch(out)
        out = [packed()] if found else []
        yield batch(out + list(looks.rows()))

    return run


def _settled(kinds: dict[str | None, int]) -> str | None:
    """The kind of a field from the numbers of its values of each."""
    if "whole" in kinds and "real" in kinds:
        return "real"
    known = [(n, k) for k, n in kinds.items() if k is not None]
    return max(known)[1] if known else None


_SCAN_TYPES = [
    pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("path", pa.string()), ("kind", pa.string())])),
    pa.list_(pa.struct([("path", pa.string()), ("kind", pa.string()), ("n", pa.int64())])), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(),
]


class Drift:
    """Schemas of the files of each feed, and the scripts between neighbours.

    ``lines`` holds one JSON object per row. Lines are known by (``file_id``, ``line_no``): one that occurs again counts once.
    Lines that aren't a whole JSON object are left out, as are rows with a null feed, sequence, file or line number; a file
    without a readable line has no schema and is passed over. Field names differ by letter case. A field that is
    null throughout a file keeps its earlier kind in the feed; if it has none, it is of any kind. A file where whole
    and real numbers mix in a field has real numbers there; other mixtures count as the most frequent kind.

    Content is compared by what the values of a name and kind look like over all files: the mean, over
    families of traits, of the Bhattacharyya coefficient. Two names are the same content under another
    name if that is at least ``ALIKE``, and if they are not found together in the same files.
    """

    def __init__(self, lines: DataFrame, feed: str, seq: str, file_id: str, line_no: str, body: str) -> None:
        self.line_keys = (feed, seq, file_id, line_no)
        known = F.lit(True)
        for c in self.line_keys:
            known = known & F.col(c).isNotNull()
        rows = lines.filter(known).select(F.col(feed).cast("string").alias(feed), F.col(seq).cast("bigint").alias(seq), F.col(file_id).cast("bigint").alias(file_id), F.col(line_no).alias("__line"), F.col(body).alias("__body"))
        # A file's lines stay together, thousand by thousand.
        self.rows = rows.withColumn("__thousand", F.floor(F.col("__line") / 1000)).repartition(file_id, "__thousand")
        in_order = self.rows.sortWithinPartitions(file_id, feed, seq, "__thousand", "__line")
        types = (
            "feed string, seq bigint, file_id bigint, fields array<struct<path:string,kind:string>>, counts array<struct<path:string,kind:string,n:bigint>>, "
            "kind string, name string, family string, trait string, n bigint"
        )
        self.scan = stage(in_order.mapInArrow(_scan(feed, seq, file_id), types), "scan")
        self.files = stage(self._files().withColumn("names", F.transform(_named("fields"), lambda f: f.path)), "files")
        self.pairs = stage(self._pairs(), "pairs")

    @property
    def lines(self) -> DataFrame:
        """Each line once."""
        return self.rows.dropDuplicates([self.line_keys[2], "__thousand", "__line"]).drop("__thousand")

    def _files(self) -> DataFrame:
        """One row per readable file: its fields as (path, kind), sorted."""
        ids = ["feed", "seq", "file_id"]
        parts = self.scan.filter(F.col("feed").isNotNull())
        one = parts.groupBy(*ids).agg(F.count(F.lit(1)).alias("parts"), F.first("fields").alias("fields"))
        # Files of more lines than a thousand are put together from their parts' counts.
        many = parts.join(one.filter("parts > 1").select(*ids), ids, "left_semi").select(*ids, F.inline("counts"))
        counted = many.groupBy(*ids, "path", "kind").agg(F.sum("n").alias("n"))
        has = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)) > 0
        best = F.max_by("kind", F.when(F.col("kind").isNotNull(), F.struct("n", "kind")))
        settled = counted.groupBy(*ids, "path").agg(F.when(has("whole") & has("real"), F.lit("real")).otherwise(best).alias("kind"))
        large = settled.groupBy(*ids).agg(F.collect_list(F.struct("path", "kind")).alias("fields"))
        known = one.filter("parts = 1").select(*ids, "fields").unionByName(large)
        known = stage(known.withColumn("fields", F.array_sort(F.filter("fields", lambda f: f.path != ""))), "known")
        # A field that is null throughout a file looks back for its kind, along the files of its feed that have it.
        top = known.select(*ids, F.explode("fields").alias("f")).select(*ids, F.col("f.path").alias("path"), F.col("f.kind").alias("kind")).filter(~F.col("path").contains(SEP))
        asked = top.filter(F.col("kind").isNull()).select("feed", "path").distinct()
        line = before(top.join(asked, ["feed", "path"], "left_semi"), ["feed", "path"], "seq", F.col("kind"), "earlier", F.floor(F.col("seq") / FILES), known=True)
        told = line.filter(F.col("kind").isNull() & F.col("earlier").isNotNull())
        told = told.groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.struct("path", "earlier"))).alias("told"))
        filled = F.transform("fields", lambda f: F.struct(f.path.alias("path"), F.coalesce(f.kind, F.element_at("told", f.path)).alias("kind")))
        return known.join(told, ids, "left").select(*ids, F.when(F.col("told").isNull(), F.col("fields")).otherwise(filled).alias("fields"))

    def _pairs(self) -> DataFrame:
        """Each file that differs with the fields of the file before, and the names that it no longer has and that came."""
        x = before(self.files, ["feed"], "seq", F.struct("fields", "names"), "earlier", F.floor(F.col("seq") / FILES))
        x = x.filter(F.col("earlier").isNotNull() & (F.col("earlier.fields") != F.col("fields")))
        gone, come = F.array_except("earlier.names", "names"), F.array_except("names", "earlier.names")
        return x.select("feed", "seq", "file_id", F.col("earlier.fields").alias("old"), F.col("fields").alias("new"), gone.alias("gone"), come.alias("come"))

    def likeness(self) -> DataFrame:
        """(old, new, kind, alike) of the names that some file drops and brings at once."""
        swapped = self.pairs.filter((F.size("gone") > 0) & (F.size("come") > 0))
        both = swapped.select(F.explode(_among("old", "gone")).alias("a"), _among("new", "come").alias("come"))
        both = both.select("a", F.explode("come").alias("b")).filter(F.col("a.kind").isNull() | F.col("b.kind").isNull() | (F.col("a.kind") == F.col("b.kind")))
        depth = lambda c: F.size(F.split(c, SEP))
        both = both.filter(depth(F.col("a.path")) == depth(F.col("b.path")))
        wanted = both.select(F.col("a.path").alias("old"), F.col("b.path").alias("new"), F.coalesce("a.kind", "b.kind").alias("wanted")).distinct()

        wanted = stage(wanted, "wanted")  # pairs of field names: read four times
        pairs = wanted.select("old", "new").distinct()
        alike = self._alike(pairs)
        apart = self._together(pairs).filter(F.col("together") <= TOGETHER * F.least("na", "nb")).select("old", "new")
        by_kind = wanted.join(alike, ["old", "new"], "left").filter(F.col("wanted").isNull() | F.col("kind").isNull() | (F.col("wanted") == F.col("kind")))
        score = by_kind.groupBy("old", "new", "wanted").agg(F.max(F.coalesce("alike", F.lit(0.0))).alias("alike"))
        return score.join(apart, ["old", "new"])

    def _alike(self, pairs: DataFrame | None = None) -> DataFrame:
        """(old, new, kind, alike): likeness of content of pairs of names, or of all that share a trait."""
        looks = self.scan.filter(F.col("name").isNotNull() & F.col("kind").isNotNull()).groupBy("name", "kind", "family", "trait").agg(F.sum("n").alias("n"))
        whole = Window.partitionBy("name", "kind", "family")
        looks = looks.select("name", "kind", "family", "trait", (F.col("n") / F.sum("n").over(whole)).alias("p"))
        families = looks.groupBy("name", "kind").agg(F.collect_set("family").alias("families"))
        a = looks.select(F.col("name").alias("old"), "kind", "family", "trait", F.col("p").alias("pa"))
        b = looks.select(F.col("name").alias("new"), "kind", "family", "trait", F.col("p").alias("pb"))
        both = a.join(b, ["kind", "family", "trait"]).filter(F.col("old") < F.col("new")) if pairs is None else pairs.join(a, "old").join(b, ["new", "kind", "family", "trait"])
        shared = both.groupBy("old", "new", "kind").agg(F.sum(F.sqrt(F.col("pa") * F.col("pb"))).alias("s"))
        fa = families.select(F.col("name").alias("old"), "kind", F.col("families").alias("fa"))
        fb = families.select(F.col("name").alias("new"), "kind", F.col("families").alias("fb"))
        return shared.join(fa, ["old", "kind"]).join(fb, ["new", "kind"]).select("old", "new", "kind", (F.col("s") / F.size(F.array_union("fa", "fb"))).alias("alike"))

    def _together(self, pairs: DataFrame) -> DataFrame:
        """(old, new, together, na, nb): in how many files both names of a pair are, and each of them."""
        # Files with equal sets of names are counted before names are paired.
        sets = self.files.select("names").groupBy("names").agg(F.count(F.lit(1)).alias("n"))
        one = sets.select(F.explode("names").alias("name"), "n").groupBy("name").agg(F.sum("n").alias("files"))
        held = sets.select(F.explode("names").alias("old"), "names", "n").join(pairs, "old").filter(F.array_contains("names", F.col("new"))).groupBy("old", "new").agg(F.sum("n").alias("together"))
        x = pairs.join(held, ["old", "new"], "left").join(one.withColumnsRenamed({"name": "old", "files": "na"}), "old").join(one.withColumnsRenamed({"name": "new", "files": "nb"}), "new")
        return x.withColumn("together", F.coalesce("together", F.lit(0)))

    def changes(self) -> DataFrame:
        """Every step of every script: ``feed, file_id, depth, field, to_depth, to, change``; paths are joined by dots.

        ``depth`` is that of the field before (of the new one for ``added``), ``to_depth`` that of the field after (null if there is none).
        """
        alike = stage(self.likeness().filter(F.col("alike") >= ALIKE), "alike")
        swapped = self.pairs.filter((F.size("gone") > 0) & (F.size("come") > 0))
        cand = swapped.select("feed", "file_id", _among("new", "come").alias("new"), F.explode(_among("old", "gone")).alias("a"))
        cand = cand.select("feed", "file_id", "new", F.col("a.path").alias("old"), F.col("a.kind").alias("ka"))
        cand = cand.join(alike.withColumnRenamed("new", "to"), "old")
        hit = F.exists("new", lambda g: (g.path == F.col("to")) & F.coalesce(F.col("ka"), g.kind).eqNullSafe(F.col("wanted")))
        prices = cand.filter(hit).groupBy("feed", "file_id").agg(F.collect_set(F.struct("old", F.col("to").alias("new"), "alike")).alias("prices"))
        work = self.pairs.select("feed", "file_id", "old", "new").join(prices, ["feed", "file_id"], "left")
        return work.mapInPandas(_scripts, "feed string, file_id bigint, depth int, field string, to_depth int, to string, change string")

    def fields(self) -> DataFrame:
        """The top-level fields of each readable file: ``feed, file_id, field, kind`` (null where no file of the feed tells it)."""
        x = self.files.select("feed", "file_id", F.explode("fields").alias("f")).filter(~F.col("f.path").contains(SEP))
        names = F.create_map(*[y for k, v in KINDS.items() for y in (F.lit(k), F.lit(v))])
        return x.select("feed", "file_id", F.col("f.path").alias("field"), F.element_at(names, F.col("f.kind")).alias("kind"))

    def canonical(self, changes: DataFrame, most: int = 10_000) -> dict[str, str]:
        """The name that stands for each field name: the most frequent of those that renames, or like content in different files, link.

        The field names of a feed are a vocabulary, not data; more than ``most`` are refused.
        """
        top = self.files.select(F.explode("fields").alias("f")).filter(~F.col("f.path").contains(SEP)).groupBy(F.col("f.path").alias("name")).agg(F.count(F.lit(1)).alias("n"))
        count = {r.name: r.n for r in top.limit(most + 1).collect()}
        if len(count) > most:
            raise ValueError(f"more than {most} field names")
        renamed = changes.filter((F.col("change") == "renamed") & (F.col("depth") == 1)).groupBy(F.col("field").alias("old"), F.col("to").alias("new")).agg(F.count(F.lit(1)).cast("double").alias("w"))
        # Names of like content that chance would have brought together, but that never are, stand for one field, too.
        alike = self._alike().filter(~F.col("old").contains(SEP) & ~F.col("new").contains(SEP)).groupBy("old", "new").agg(F.max("alike").alias("alike")).filter(F.col("alike") >= SAME)
        feeds = self.files.select("feed", F.explode("fields").alias("f")).select("feed", F.col("f.path").alias("name")).groupBy("name").agg(F.countDistinct("feed").alias("feeds"))
        size = lambda c: feeds.withColumnsRenamed({"name": c, "feeds": f"feeds_{c}"})
        apart = self._together(alike.select("old", "new")).filter(F.col("together") == 0).join(alike, ["old", "new"]).join(size("old"), "old").join(size("new"), "new")
        whole = self.files.agg(F.countDistinct("feed").alias("whole"))
        apart = apart.join(F.broadcast(whole), how="cross").filter(F.col("feeds_old") * F.col("feeds_new") >= 2 * F.col("whole"))  # one row
        # Links between names of a vocabulary of at most ``most``; renames first.
        links = [(1, r.w, r.old, r.new) for r in renamed.collect()] + [(0, r.alike, r.old, r.new) for r in apart.select("old", "new", "alike").collect()]
        linked = sorted({n for _, _, a, b in links for n in (a, b)})
        member = {n: {n} for n in count}
        if linked:
            top_names = F.transform(F.filter("fields", lambda f: ~f.path.contains(SEP)), lambda f: f.path)
            sets = self.files.select(F.array_intersect(top_names, F.array(*[F.lit(n) for n in linked])).alias("names")).groupBy("names").agg(F.count(F.lit(1)).alias("n"))
            met = sets.select(F.explode("names").alias("a"), "names", "n").select("a", F.explode("names").alias("b"), "n").filter("a < b").groupBy("a", "b").agg(F.sum("n").alias("n"))
            met = {(r.a, r.b): r.n for r in met.collect()}
        for _, _, a, b in sorted(links, key=lambda x: (-x[0], -x[1], x[2], x[3])):
            one, two = member[a], member[b]
            if one is two:
                continue
            # Names found in the same files are different fields, and so are those that stand for them.
            if any(met.get((min(x, y), max(x, y)), 0) > TOGETHER * min(count[x], count[y]) for x in one for y in two):
                continue
            one |= two
            for n in two:
                member[n] = one
        return {n: max(m, key=lambda x: (count[x], x)) for n, m in member.items()}

    def projections(self, names: dict[str, str]) -> DataFrame:
        """The projection of each file, one row each: ``feed, seq, file_id, projection``, the fields of the file that stand for each canonical name."""
        spark = self.files.sparkSession
        told = spark.createDataFrame(sorted(names.items()), "field string, canonical string")  # a vocabulary, as large as ``names``
        x = self.files.select("feed", "seq", "file_id", F.explode("fields").alias("f")).select("feed", "seq", "file_id", F.col("f.path").alias("field")).join(told, "field")
        x = x.groupBy("feed", "seq", "file_id", "canonical").agg(F.sort_array(F.collect_list(F.struct((F.col("field") != F.col("canonical")).alias("o"), "field"))).alias("l"))
        x = x.withColumn("l", F.transform("l", lambda e: e.field))
        return x.groupBy("feed", "seq", "file_id").agg(F.map_from_entries(F.collect_list(F.struct("canonical", "l"))).alias("projection"))

    def types(self, names: dict[str, str]) -> dict[str, str]:
        """The SQL type of each canonical name: what holds the kinds it has in all files."""
        top = self.files.select(F.explode("fields").alias("f")).filter(~F.col("f.path").contains(SEP)).groupBy(F.col("f.path").alias("name"))
        kinds: dict[str, set] = {}
        for r in top.agg(F.collect_set("f.kind").alias("kinds")).collect():  # the vocabulary again
            kinds.setdefault(names.get(r.name, r.name), set()).update(r.kinds)
        plain = {frozenset(["whole"]): "bigint", frozenset(["real"]): "double", frozenset(["whole", "real"]): "double", frozenset(["bool"]): "boolean"}
        return {n: plain.get(frozenset(k), "string") for n, k in kinds.items()}

    def table(self, names: dict[str, str]) -> DataFrame:
        """One row per readable line: the key columns, a column per canonical name, and ``also``.

        Each file's lines go through the projection of the file. A column is a whole number, double or truth value if its fields are that in every file, else text: strings as
        they are, numbers as they are written, lists and objects as JSON. What has no place, since two fields of a line stand for
        one canonical name or a line's value isn't of its column's type, is in the map ``also`` under the field's own name, so no value is lost.
        A canonical name that clashes, without regard to letter case, with a key column, ``also`` or another one gets a trailing ``_``.
        """
        feed, seq, file_id, line_no = self.line_keys
        fields = F.from_json("__body", "map<string,string>")
        x = self.lines.withColumn("__m", fields).filter(F.col("__m").isNotNull())
        per_file = self.projections(names).select(F.col("feed").alias(feed), F.col("seq").alias(seq), F.col("file_id").alias(file_id), F.col("projection").alias("__p"))
        x = x.join(per_file, [feed, seq, file_id], "left")
        x = x.withColumn("__used", F.transform_values("__p", lambda _, l: F.get(F.filter(l, lambda f: F.element_at("__m", f).isNotNull()), 0)))
        types = self.types(names)
        taken, cols, lost = {feed.lower(), seq.lower(), file_id.lower(), line_no.lower(), "also"}, [], []
        for stands in sorted(set(names.values())):
            out = stands
            while out.lower() in taken:
                out += "_"
            taken.add(out.lower())
            used = F.element_at("__used", F.lit(stands))
            raw = F.element_at("__m", used)
            kind = types.get(stands, "string")
            cols.append((raw if kind == "string" else raw.try_cast(kind)).alias(out))
            if kind != "string":
                lost.append(F.when(raw.isNotNull() & raw.try_cast(kind).isNull(), used))
        misfit = F.array_compact(F.array(*lost)) if lost else F.array().cast("array<string>")
        right = F.coalesce(F.map_values("__used"), F.array().cast("array<string>"))
        also = F.map_filter("__m", lambda k, v: v.isNotNull() & (~F.coalesce(F.array_contains(right, k), F.lit(False)) | F.array_contains(misfit, k)))
        return x.select(feed, seq, file_id, F.col("__line").alias(line_no), *cols, also.alias("also"))


def _among(fields: str, names: str) -> Column:
    return F.filter(fields, lambda f: F.array_contains(F.col(names), f.path))


def _named(fields: str) -> Column:
    """The fields of a schema that have a name, at any depth: members of lists have none."""
    return F.filter(fields, lambda f: ~F.array_contains(F.split(f.path, SEP), "[]"))


def _scripts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        out: list[tuple] = []
        for feed, file_id, old, new, prices in zip(pdf["feed"], pdf["file_id"], pdf["old"], pdf["new"], pdf["prices"], strict=True):
            alike = {(p["old"], p["new"]): p["alike"] for p in (prices if prices is not None else [])}

            def rename(pa: Sequence[str], pb: Sequence[str], a: trees.Node, b: trees.Node, alike: dict = alike) -> float | None:
                pair = SEP.join(pa), SEP.join(pb)
                return None if (a.kind and b.kind and a.kind != b.kind) or pair not in alike else 1.0 - alike[pair]

            tree = [trees.build([(f["path"], f["kind"]) for f in side]) for side in (old, new)]
            for s in trees.edit_script(*tree, rename)[1]:
                at = s.new if s.action == "added" else s.old
                out.append((feed, file_id, len(at), ".".join(at), len(s.new) or None, ".".join(s.new) or None, s.action))
        frame = pd.DataFrame(out, columns=["feed", "file_id", "depth", "field", "to_depth", "to", "change"])
        yield frame.astype({"to_depth": "Int32"})
