"""One query per operator: the Spark side and, where SQL can say it, the DuckDB side."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lureframe.functions import urls as uf
from lureframe.functions.bind import unnest
from lureframe.operators import datasets as ds, entities as en, evaluate as ev, model as ml, rules, signals, urls
from lureframe.plans import triage as plan
from lureframe.sources import results as res

from . import fixture as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}
#: The tables of a whole store; one for dashboards alone has an index and a summary only.
WHOLE, SUMMARY_ONLY = tuple(res.TABLES), ()


def register(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = (fn, sql)
        return fn

    return add


def n(c) -> F.Column:
    return c.cast("bigint")


def joined(c, sep: str = "|"):
    return F.array_join(c, sep)


class Stages:
    """Plans of the stages over one set of tables, built on demand (plans only, no data)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._plans = spark, sf_dir, {}

    def _get(self, name, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._plans:
            self._plans[name] = make()
        return self._plans[name]

    def _store(self, name: str, df: DataFrame) -> DataFrame:
        """Write a derived table once per session and read it back: a short plan, and nothing is recomputed."""
        path = res.shared_folder(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def table(self, name: str) -> DataFrame:
        return fx.table(self.spark, self.dir, name)

    @property
    def messages(self):
        return self._get("messages", lambda: self._store("messages", fx.messages(self.spark, self.dir)))

    @property
    def body(self):
        return self._get("body", lambda: plan.ingest_stage(self.messages).where("reject_reason is null"))

    @property
    def scanned(self):
        return self._get("scanned", lambda: signals.text_signals(self.body))

    @property
    def entities(self):
        return self._get("entities", lambda: plan.entity_stage(self.scanned))

    @property
    def matched(self):
        return self._get("matched", lambda: rules.match_rules(self.entities))

    @property
    def classified(self):
        return self._get("classified", lambda: self._per_content(plan.text_stage))

    @property
    def urls(self):
        return self._get("urls", lambda: urls.url_facts(en.merge_explicit_urls(en.extract_urls(self.body))))

    @property
    def url_table(self):
        raw = lambda: unnest(en.merge_explicit_urls(en.extract_urls(self.body)), "all_urls", item="url").select("url").distinct()
        return self._get("url_table", lambda: urls.analyze_urls(raw()))

    @property
    def host_rows(self):
        """Every URL occurrence with an id and its host."""
        rows = lambda: unnest(en.merge_explicit_urls(en.extract_urls(self.body)), "all_urls", "msg_id", item="raw_url")
        return self._get("host_rows", lambda: rows().select(
            (F.col("msg_id") * 100 + F.col("ord")).alias("url_id"), uf.host_of(uf.absolute(F.col("raw_url"))).alias("host")))

    @property
    def page_hosts(self):
        return self._get("page_hosts", lambda: self.table("pages").select("page_id", "url", uf.host_of(F.col("url")).alias("host")))

    @property
    def impersonated(self):
        return self._get("impersonated", lambda: self._per_content(lambda rows: plan.url_stage(plan.text_stage(rows))))

    def _per_content(self, stage: Callable[[DataFrame], DataFrame], messages: DataFrame | None = None) -> DataFrame:
        """A stage of the (given) messages with something to assess, run once for equal contents."""
        return plan.per_content(self.messages if messages is None else messages, lambda rows: stage(plan.ingest_stage(rows).where("reject_reason is null")))

    @property
    def refined(self):
        return self._get("refined", lambda: self._per_content(lambda rows: plan.refine_stage(plan.url_stage(plan.text_stage(rows)))))

    def _features(self, messages: DataFrame) -> DataFrame:
        match = lambda rows: rules.match_rules(plan.entity_stage(signals.text_signals(rows)))
        return self._per_content(lambda rows: ml.predict_heuristic(ml.features(match(rows))), messages)

    @property
    def featured(self):
        return self._get("featured", lambda: self._features(self.messages))

    @property
    def templates(self):
        """The messages with an expected outcome; contents of the others need no assessment where only these count."""
        return self.messages.where("is_scam is not null")

    @property
    def outcomes(self):
        """Probability beside the truth for the template messages, stored because a threshold search reads it often."""
        rows = lambda: self._features(self.templates).select("msg_id", "probability", "is_scam")
        return self._get("outcomes", lambda: self._store("outcomes", rows()))

    @property
    def training(self):
        """Features of the template messages with their label, stored because training reads them often."""
        rows = lambda: self._features(self.templates).select(
            F.col("msg_id").alias("id"), "features", F.when(F.col("is_scam"), "scam").otherwise("benign").alias("label"))
        return self._get("training", lambda: ds.stratified_split(self._store("features", rows()), key="id"))

    @property
    def model(self):
        return self._get("model", lambda: ml.train_classifier(self.training.where("split = 'train'")))

    @property
    def predicted(self):
        return self.featured

    @property
    def triaged(self):
        return self._get("triaged", lambda: plan.triage(self.messages).where("reject_reason is null"))

    def _holding(self, name: str, tables: tuple[str, ...], make: Callable[[], object]):
        """What ``make`` gives for a store with these tables, once per session; one that holds them and more will do."""
        known = [v for k, v in self._plans.items() if isinstance(k, tuple) and k[0] == name and set(tables) <= set(k[1])]
        return known[0] if known else self._get((name, tables), make)

    def assessed(self, tables: tuple[str, ...] = WHOLE) -> DataFrame:
        """What a store with these tables needs of the assessed messages, written once per session: the batch of all stores here."""
        return self._holding("assessed", tables, lambda: self._store("assessed", res.stored_columns(self.triaged, tables)))

    def stored(self, *tables: str) -> dict[str, DataFrame]:
        """Result tables (all six unless named), written once per session and read back."""
        tables = tables or WHOLE

        def make():
            path = res.shared_folder(self.spark, "results")
            res.write_results(self.assessed(tables), path, stored=True, tables=tables)
            return res.read_results(self.spark, path)
        return self._holding("stored", tables, make)

    def store(self, name: str, tables: tuple[str, ...] = WHOLE) -> str:
        """A store of its own whose batch was written twice: whole, and two thirds of it again under a new name, like a repeated job."""
        path, batch = res.shared_folder(self.spark, name), self.assessed(tables)
        res.write_results(batch, path, stored=True, tables=tables)
        res.write_results(batch.where("msg_id % 3 <> 0"), path, stored=True, tables=tables)
        return path

    def rewritten(self, tables: tuple[str, ...] = WHOLE) -> str:
        return self._holding("rewritten", tables, lambda: self.store("rewritten", tables))

    def purged(self, tables: tuple[str, ...] = WHOLE) -> str:
        """Such a store after a purge of half of one owner's messages, compacted between two parts of it."""
        def make():
            path = self.store("purged", tables)
            ids = self.messages.where("msg_id % 2 = 0").select("msg_id")
            res.purge_results(self.spark, path, ids.where("msg_id % 5 = 0"), 8)
            res.compact_results(self.spark, path)
            res.purge_results(self.spark, path, ids, 8)
            return path
        return self._holding("purged", tables, make)

    @property
    def labelled(self):
        """documents x labels in the shape of a labelled dataset, with some rows made invalid."""
        def make():
            d, lab_ = self.table("documents").select("doc_id", "text", "lang", "source"), self.table("labels").select("doc_id", "toxic")
            i = F.col("doc_id")
            text_id = F.when(i % 3 == 0, F.concat(F.lit("doc-"), (i % 500).cast("string"))).otherwise("")
            return d.join(lab_, "doc_id", "left").select(
                i.alias("ord"), text_id.alias("id"), F.when(i % 11 == 1, "").otherwise(F.col("text")).alias("text"),
                F.when(i % 22 == 1, "http://a.example").otherwise("").alias("urls"),
                F.when(i % 11 == 2, "").when(i % 11 == 3, "Junk").when(F.coalesce("toxic", i % 2) == 1, "Scam").otherwise("benign").alias("label"),
                F.when(i % 11 == 4, "no_such").when(i % 11 == 5, "phishing").when(i % 4 == 0, "").otherwise("unknown").alias("scam_category"),
                "source", F.col("lang").alias("language"), F.lit("").alias("timestamp"),
                F.when(i % 11 == 6, "high").when(i % 11 == 7, "1.5").when(i % 2 == 0, "0.9").otherwise("").alias("annotation_confidence"),
                F.lit("").alias("notes"))
        return self._get("labelled", make)

    @property
    def checked_rows(self):
        return self._get("checked_rows", lambda: ds.validate_dataset(ds.canonical_rows(self.labelled)))

    @property
    def valid_rows(self):
        return self._get("valid_rows", lambda: self.checked_rows.where(F.size("errors") == 0))

    @property
    def judged(self):
        """Outcomes of the template messages beside what is expected of them."""
        def make():
            t = plan.triage(self.templates, with_report=False).where("reject_reason is null")
            kind = F.when(F.size("input_types") > 1, "text+url").otherwise(F.col("input_types")[0])
            return ev.case_verdict(self._store("judged", t.select(
                "msg_id", "is_scam", "expected_category", "min_level", "note", "level", "primary", "probability", kind.alias("input_type"),
                F.when(F.col("expected_category") == "phishing", F.array(F.lit("account_takeover"), F.lit("unknown"))).otherwise(
                    F.expr("cast(array() as array<string>)")).alias("acceptable"))))
        return self._get("judged", make)


_PLANS: dict[tuple[str, str], Stages] = {}


def stages(spark: SparkSession, sf_dir: str) -> Stages:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PLANS:
        _PLANS[key] = Stages(spark, sf_dir)
    return _PLANS[key]
