"""Merging repeated attempts on a site into one row.

best_attempt picks a row by a total order, in one aggregation. merge_attempts is
the full merge: an ordered fold, in which each step may keep the older row for
its richer contact data and fills its blanks from the loser, so later steps see
filled rows. It does not commute, so it folds each site's rows in order by
aggregate() over a sorted array. A site with more than SEGMENT rows is folded segment
by segment, from the state that the segments before it left; no array is longer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webgrain.functions import color, status
from webgrain.functions import url as U
from webgrain.functions.base import count_true, distinct_by, filled, is_filled, let, trim
from webgrain.operators import presence as P
from webgrain.shared import saved
from webgrain.sources import files, typed
from webgrain.sources.sinks import write_csv

#: Columns that a winner takes from the loser where its own are blank.
FILLED = [
    "ds_number", "ds_id", "project_title", "project_type", "shop_code", "source_column", "palette_source",
    "palette_confidence", "extracted_color_hexes", "primary_color_hex", "secondary_color_hex",
    "extracted_business_name", "extracted_summary", "logo_candidate_count", "selected_logo_url",
    "logo_candidate_urls", "extracted_emails", "extracted_phone_numbers", "extracted_social_links",
    "extracted_contact_links", "extraction_run_id", "processed_at",
]
#: Columns that count for a row's priority, and the weights of that count.
COUNTED = [
    "domain", "canonical_domain", "normalized_url", "extracted_business_name", "extracted_business_category",
    "extracted_tagline", "extracted_summary", "logo_candidate_urls", "selected_logo_url", "logo_candidate_count",
    "extracted_color_hexes", "primary_color_hex", "secondary_color_hex", "extracted_emails", "extracted_phone_numbers",
    "extracted_social_links", "extracted_addresses", "extracted_contact_links", "extracted_products", "extracted_services",
    "extracted_products_services", "status", "error_message", "pages_inspected", "elapsed_ms", "extraction_provider",
    "extraction_model", "business_name_score", "category_score", "logo_score", "brief_score", "overall_score", "reviewer_notes",
]
PROCESSED, SUCCEEDED, FAILED, PER_FIELD = 1_000_000, 500_000, 200_000, 1_000
MOST_COLORS, MORE_COLORS, MORE_SCORE = 8, 3, 1
ADDED = ["latest_rerun_status", "latest_rerun_timestamp", "preserved_previous_success", "preserved_richer_contact", "n_attempts"]
#: Most rows that one array holds.
SEGMENT = 1024


def attempt_key(prefix: str = "") -> Column:
    """Site key, else 'ds:number', else a key of the row's own."""
    c = lambda n: F.col(f"{prefix}{n}")
    site = U.site_key(c("canonical_domain"), c("domain"), c("normalized_url"), F.lit(None).cast("string"))
    own = F.concat_ws(":", F.lit("row"), F.coalesce(filled(c("ds_id")), filled(c("project_title")), F.lit("")), c("seq").cast("string"))
    return F.coalesce(site, F.concat(F.lit("ds:"), filled(c("ds_number"))), own)


def _when() -> Column:
    return status.sort_millis(F.col("processed_at"), F.col("extraction_run_id"), F.col("source_review_queue"))


def best_attempt(rows: DataFrame, key: Column, seq_col: str = "seq") -> DataFrame:
    """The best row of each key: by status, time, filled fields, host without www., then the first."""
    n_filled = sum((is_filled(F.col(c)).cast("int") for c in FILLED if c in rows.columns), F.lit(0))
    www = (U.is_www(F.col("domain")) | U.is_www(F.col("normalized_url"))).cast("int")
    order = F.struct(status.outcome_rank(status.status(F.col("status"))).alias("o"), _when().alias("t"), n_filled.alias("n"), (-www).alias("w"), (-F.col(seq_col)).alias("s"))
    each = rows.select(key.alias("attempt_key"), F.struct(*rows.columns).alias("row"), order.alias("order"))
    return each.groupBy("attempt_key").agg(F.max_by("row", "order").alias("row"), F.count("*").alias("n_attempts")).select("attempt_key", "row.*", "n_attempts")


#: Cells that the fold treats by rules of their own.
_SPECIAL = ["processed_at", "extraction_run_id", "source_review_queue", "duplicate_source_urls", "extracted_addresses"]
_COLORS = ["primary_color_hex", "secondary_color_hex", "extracted_color_hexes"]
_VARIANT = "struct<normalized_url: string, domain: string, canonical_domain: string, raw_url: string, source_column: string>"


def _cells(rows: DataFrame) -> list[str]:
    return [c for c in typed.REVIEWS if c in rows.columns and c not in _SPECIAL]


def _col(rows: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in rows.columns else F.lit("")


def _state(rows: DataFrame, cells: list[str]) -> Column:
    """What the fold knows of a row: its cells, what each of them is worth, its times and variants."""
    c = lambda n: _col(rows, n)
    worth = {
        "extracted_emails": P.has_email, "extracted_phone_numbers": P.has_phone, "extracted_social_links": P.has_social,
        "logo_candidate_urls": lambda: F.size(P.json_objects(c("logo_candidate_urls"))) > 0,
        "logo_candidate_count": lambda: F.coalesce(F.regexp_extract(trim(c("logo_candidate_count")), r"^(\d+)", 1).try_cast("long") > 0, F.lit(False)),
    }
    codes = [F.filter(F.array(color.hex_code(c(n))), lambda x: x.isNotNull()) for n in _COLORS[:2]]
    listed = F.filter(F.transform(color.hex_list(c(_COLORS[2])), color.hex_code), lambda x: x.isNotNull())
    run, queue = trim(c("extraction_run_id")), trim(c("source_review_queue"))

    def stamp(text: Column, run_id: Column) -> Column:
        iso = status.run_id_iso(run_id)
        return F.struct(text.alias("text"), F.coalesce(iso, F.lit("")).alias("iso"), F.coalesce(status.millis(iso), run_id.try_cast("long")).alias("t"), run_id.alias("run"))

    own = trim(c("processed_at"))
    variant = F.struct(filled(c("normalized_url")).alias("normalized_url"), filled(c("domain")).alias("domain"), filled(c("canonical_domain")).alias("canonical_domain"), F.lit(None).cast("string").alias("raw_url"), filled(c("source_column")).alias("source_column"))
    return F.struct(
        F.array(*(c(n) for n in cells)).alias("cells"),
        F.array(*(is_filled(c(n)) for n in cells)).alias("filled"),
        F.array(*((worth[n]() if n in worth and n in rows.columns else is_filled(c(n))) for n in cells)).alias("good"),
        F.array(*codes, listed).alias("colors"),
        c("extracted_addresses").alias("addresses"),
        (P.has_plausible_address() if "extracted_addresses" in rows.columns else F.lit(False)).alias("place"),
        F.struct(own.alias("text"), status.millis(filled(own)).alias("t")).alias("at"),
        stamp(run, run).alias("run"),
        stamp(queue, status.run_id_of(queue)).alias("queue"),
        variant.alias("variant"),
        variants_of(c("duplicate_source_urls")).alias("variants"),
        c("duplicate_source_urls").alias("duplicates"),
        P.has_offerings().alias("offers") if "extracted_products" in rows.columns else F.lit(False).alias("offers"),
        F.regexp_extract(trim(c("overall_score")), r"^[+-]?(\d+\.?\d*|\.\d+)", 0).try_cast("double").alias("score"),
        status.outcome_rank(status.status(c("status"))).alias("rank"),
        trim(c("status")).alias("status"),
        (U.is_www(c("domain")) | U.is_www(c("normalized_url"))).alias("www"),
        F.struct(*(n for n in rows.columns if n not in cells and n not in _SPECIAL)).alias("rest"),
        trim(c("status")).alias("latest_status"),
        F.lit("").alias("latest_at"),
        F.lit("").alias("previous"),
        F.lit("").alias("richer"),
        F.lit(1).cast("long").alias("n"),
    )


def row_priority(cell) -> Column:
    """What a row's status, filled cells, time and host weigh; cell(name) gives a cell."""
    n = count_true(*(is_filled(cell(c)) for c in COUNTED))
    processed, success = is_filled(cell("status")), trim(cell("status")) == "success"
    time = status.sort_millis(cell("processed_at"), cell("extraction_run_id"), cell("source_review_queue"))
    of_status = F.when(success, PROCESSED + SUCCEEDED).when(processed, PROCESSED + FAILED).otherwise(0)
    return of_status + PER_FIELD * n + time + F.when(U.is_www(cell("domain")) | U.is_www(cell("normalized_url")), 0).otherwise(1)


class _Fold:
    """The merge of two states, as expressions; cells are found by their place."""

    def __init__(self, cells: list[str]):
        self.at = {c: k for k, c in enumerate(cells)}
        self.fills = F.array(*(F.lit(c in FILLED) for c in cells))
        self.counts = F.array(*(F.lit(c in COUNTED) for c in cells))

    def good(self, x: Column, name: str) -> Column:
        return F.get(x["good"], F.lit(self.at[name])) if name in self.at else F.lit(False)

    def time(self, x: Column) -> Column:
        run = F.when(x["run"]["text"] != "", F.coalesce(x["run"]["t"], x["queue"]["t"])).otherwise(x["queue"]["t"])
        return F.coalesce(x["at"]["t"], run, F.lit(0).cast("long"))

    def iso(self, x: Column) -> Column:
        return F.when(x["at"]["text"] != "", x["at"]["text"]).when(x["run"]["text"] != "", x["run"]["iso"]).otherwise(x["queue"]["iso"])

    def priority(self, x: Column) -> Column:
        n = F.size(F.filter(x["filled"], lambda f, i: f & F.get(self.counts, i))) + is_filled(x["addresses"]).cast("int")
        processed = x["status"] != ""
        status_score = F.when(processed, PROCESSED).otherwise(0) + F.when(x["status"] == "success", SUCCEEDED).when(processed, FAILED).otherwise(0)
        return status_score + PER_FIELD * n + self.time(x) + F.when(x["www"], 0).otherwise(1)

    def contact(self, x: Column) -> Column:
        return count_true(*(self.good(x, f"extracted_{n}") for n in ("emails", "phone_numbers", "social_links")), x["place"])

    def n_colors(self, x: Column) -> Column:
        return F.least(F.size(F.array_distinct(F.flatten(x["colors"]))), F.lit(MOST_COLORS))

    def gains(self, old: Column, new: Column) -> Column:
        logo = lambda x: self.good(x, "selected_logo_url") | self.good(x, "logo_candidate_urls") | self.good(x, "logo_candidate_count")
        colors = lambda x: (self.n_colors(x) > 0) | self.good(x, _COLORS[0]) | self.good(x, _COLORS[1])
        fresh = [~has(old) & has(new) for has in (logo, colors, lambda x: x["offers"], lambda x: self.good(x, "extracted_summary"), lambda x: self.good(x, "palette_source"))]
        more = [(self.n_colors(old) == 0) & (self.n_colors(new) > 0), self.n_colors(new) >= self.n_colors(old) + MORE_COLORS]
        return reduce(lambda p, q: p | q, [*fresh, *more, F.coalesce(new["score"] - old["score"] >= MORE_SCORE, F.lit(False))])

    def richer(self, old: Column, new: Column) -> Column:
        return (self.contact(old) > self.contact(new)) & ~self.gains(old, new)

    def keeps_first(self, a: Column, b: Column) -> Column:
        """Whether of two states the first is the one to keep."""

        def choose(v: Column) -> Column:
            later = (v["tb"] > v["ta"]) | ((v["tb"] == v["ta"]) & (v["pb"] > v["pa"]))
            success = F.when(later, self.richer(a, b)).otherwise(~self.richer(b, a))
            other = F.when(v["ta"] != v["tb"], v["ta"] > v["tb"]).when(v["pa"] != v["pb"], v["pa"] > v["pb"]).otherwise(~(a["www"] & ~b["www"]))
            return F.when(a["rank"] != b["rank"], a["rank"] > b["rank"]).when(a["rank"] == 3, success).otherwise(other)

        return let(F.struct(self.time(a).alias("ta"), self.time(b).alias("tb"), self.priority(a).alias("pa"), self.priority(b).alias("pb")), choose)

    def step(self, a: Column, b: Column) -> Column:
        """The state of a after b."""
        first = let(F.struct(a.alias("a"), b.alias("b")), lambda v: F.struct(v["a"].alias("a"), v["b"].alias("b"), self.keeps_first(v["a"], v["b"]).alias("first")))
        sides = lambda v: F.struct(v["a"].alias("a"), v["b"].alias("b"), v["first"].alias("first"), F.when(v["first"], v["a"]).otherwise(v["b"]).alias("k"), F.when(v["first"], v["b"]).otherwise(v["a"]).alias("o"))
        return let(let(first, sides), self._merged)

    def _merged(self, v: Column) -> Column:
        a, b, k, o = v["a"], v["b"], v["k"], v["o"]
        takes = F.transform(k["filled"], lambda f, i: F.get(self.fills, i) & ~f & F.get(o["filled"], i))
        blank = F.struct(F.lit("").alias("text"), F.lit("").alias("iso"), F.lit(None).cast("long").alias("t"), F.lit("").alias("run"))
        queue = F.when(k["queue"]["text"] != "", k["queue"]).otherwise(o["queue"])
        inferred = F.struct(queue["run"].alias("text"), queue["iso"].alias("iso"), queue["t"].alias("t"), queue["run"].alias("run"))
        run = F.when(k["run"]["text"] != "", k["run"]).when(o["run"]["text"] != "", o["run"]).when(queue["run"] != "", inferred).otherwise(blank)
        of_run = F.struct(run["iso"].alias("text"), status.millis(filled(run["iso"])).alias("t"))
        at = F.when(k["at"]["text"] != "", k["at"]).when(o["at"]["text"] != "", o["at"]).otherwise(of_run)
        place = ~k["place"] & o["place"]
        newer, older = F.when(self.time(a) >= self.time(b), a).otherwise(b), F.when(self.time(a) >= self.time(b), b).otherwise(a)
        keeps_newer = v["first"] == (self.time(a) >= self.time(b))
        variants = F.concat(a["variants"], b["variants"], F.array(o["variant"]))
        spelled = F.filter(variants, lambda x: variant_key(x).isNotNull() & F.coalesce(variant_key(x) != variant_key(k["variant"]), F.lit(True)))
        made = let(takes, lambda t: F.struct(*(_taken(k, o, t, part).alias(part) for part in ("cells", "good", "filled"))))
        colors = let(takes, lambda t: F.array(*(F.when(F.get(t, F.lit(self.at[c])), F.get(o["colors"], F.lit(j))).otherwise(F.get(k["colors"], F.lit(j))) if c in self.at else F.get(k["colors"], F.lit(j)) for j, c in enumerate(_COLORS))))
        return F.struct(
            made["cells"].alias("cells"),
            made["filled"].alias("filled"),
            made["good"].alias("good"),
            colors.alias("colors"),
            F.when(place, o["addresses"]).otherwise(k["addresses"]).alias("addresses"),
            (k["place"] | o["place"]).alias("place"),
            at.alias("at"),
            run.alias("run"),
            F.when(k["queue"]["text"] != "", k["queue"]).otherwise(b["queue"]).alias("queue"),
            k["variant"].withField("source_column", F.coalesce(k["variant"]["source_column"], o["variant"]["source_column"])).alias("variant"),
            distinct_by(spelled, variant_key).alias("variants"),
            F.lit("").alias("duplicates"),
            k["offers"].alias("offers"),
            k["score"].alias("score"),
            k["rank"].alias("rank"),
            k["status"].alias("status"),
            k["www"].alias("www"),
            k["rest"].alias("rest"),
            newer["status"].alias("latest_status"),
            self.iso(newer).alias("latest_at"),
            F.when((older["rank"] == 3) & (newer["rank"] == 2) & ~keeps_newer, "true").otherwise("").alias("previous"),
            F.when((older["rank"] == 3) & (newer["rank"] == 3) & ~keeps_newer & self.richer(older, newer), "true").otherwise("").alias("richer"),
            (a["n"] + b["n"]).alias("n"),
        )


def _taken(k: Column, o: Column, takes: Column, part: str) -> Column:
    """The kept state's cells, those that it takes replaced by the other's."""
    return F.transform(k[part], lambda x, i: F.when(F.get(takes, i), F.get(o[part], i)).otherwise(x))


def variant_key(v: Column) -> Column:
    """What makes two spellings of a site one: address, else domain, else the raw address; null for none."""
    low = lambda n: F.lower(filled(v[n]))
    return F.coalesce(F.concat(F.lit("url:"), low("normalized_url")), F.concat(F.lit("domain:"), low("domain")), F.concat(F.lit("raw:"), low("raw_url")))


def variants_of(duplicates: Column) -> Column:
    """The spellings in a cell, from the objects of its JSON list; other items and other text give none."""
    return F.transform(F.filter(P.json_objects(duplicates), lambda x: x.startswith("{")), lambda x: F.from_json(x, _VARIANT))


def shown_variants(duplicates: Column) -> Column:
    """Labels of the other spellings in a cell, distinct whatever the case."""
    labels = F.transform(variants_of(duplicates), lambda v: F.coalesce(*(filled(v[n]) for n in ("normalized_url", "domain", "raw_url", "canonical_domain"))))
    return distinct_by(F.filter(labels, lambda x: x.isNotNull()), F.lower)


def merge_attempts(rows: DataFrame, seq_col: str = "seq", segment: int = SEGMENT) -> DataFrame:
    """One row of each site, merged from its attempts in the order of seq; adds the columns of ADDED and attempt_key.

    Rows come in the order of seq_col (of any type, nulls last), then by their cells.
    A site of many rows takes a job for each segment beyond the first, on the rows of
    such sites alone.
    """
    cells = _cells(rows)
    fold = _Fold(cells)
    order = [F.col(seq_col).asc_nulls_last(), F.xxhash64(*(F.col(c) for c in cells))]
    own = rows.select(attempt_key().alias("attempt_key"), F.row_number().over(Window.partitionBy(attempt_key()).orderBy(*order)).alias("nr"), _state(rows, cells).alias("state"))
    parts = own.groupBy("attempt_key", F.floor((F.col("nr") - 1) / segment).alias("part")).agg(F.sort_array(F.collect_list(F.struct("nr", "state"))).alias("states"))
    parts = parts.select("attempt_key", "part", F.transform("states", lambda s: s["state"]).alias("states"))
    folded = lambda start, rest: F.aggregate(rest, start, fold.step)
    parts = saved(parts)
    first = parts.filter("part = 0").select("attempt_key", folded(F.get("states", F.lit(0)), F.slice("states", F.lit(2), F.size("states"))).alias("state"))
    more = parts.filter("part > 0")
    last = more.agg(F.max("part")).first()[0] or 0
    done, open_ = first, None
    if last:
        long = more.select("attempt_key").distinct()
        done, open_ = first.join(long, "attempt_key", "left_anti"), saved(first.join(long, "attempt_key"))
        for part in range(1, last + 1):
            next_ = more.filter(F.col("part") == part).drop("part")
            stepped = open_.join(next_, "attempt_key", "left").withColumn("state", F.when(F.col("states").isNull(), F.col("state")).otherwise(folded(F.col("state"), F.col("states"))))
            open_ = saved(stepped.select("attempt_key", "state"))
        done = done.unionByName(open_)
    return _shown(done, rows, cells)


def _shown(done: DataFrame, rows: DataFrame, cells: list[str]) -> DataFrame:
    """Merged states as rows."""
    s = lambda n: F.col(f"state.{n}")
    merged = F.when(F.size(s("variants")) > 0, F.to_json(s("variants"))).otherwise("")
    special = {
        "processed_at": s("at.text"), "extraction_run_id": s("run.text"), "source_review_queue": s("queue.text"), "extracted_addresses": s("addresses"),
        "duplicate_source_urls": F.when(s("n") > 1, merged).otherwise(s("duplicates")),
    }
    one = lambda n: F.get(s("cells"), F.lit(cells.index(n))) if n in cells else special[n] if n in special else s(f"rest.{n}")
    fold = _Fold(cells)
    return done.select(
        "attempt_key",
        *(one(c).alias(c) for c in rows.columns),
        s("latest_status").alias("latest_rerun_status"),
        F.when(s("n") > 1, s("latest_at")).otherwise(fold.iso(F.col("state"))).alias("latest_rerun_timestamp"),
        s("previous").alias("preserved_previous_success"),
        s("richer").alias("preserved_richer_contact"),
        s("n").alias("n_attempts"),
    )


def combine_review_queues(spark: SparkSession, folder: str, out: str) -> dict[str, int]:
    """Merge all batch files of a folder, by run id and line, into one table of files ordered by address; how many rows went in and came out."""
    rows = files.read_review_queues(spark, f"{folder}/review_queue_*.csv", typed.REVIEWS)
    rows = rows.withColumn("seq", F.struct("run_id", "file_block_start", F.monotonically_increasing_id().alias("line")))
    merged = merge_attempts(rows.drop("file_name", "run_id", "file_block_start")).select(*typed.COMBINED)
    write_csv(merged.orderBy(F.lower("normalized_url"), "normalized_url"), out)
    return {"rows_read": rows.count(), "rows_written": spark.read.csv(out, header=True, multiLine=True, quote='"', escape='"').count()}
