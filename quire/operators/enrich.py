"""What a language model may be asked, and what its answers may change.

The model is behind ``Client``; everything else is relational: candidates go
out, answers come back as JSON text and are parsed, filtered and joined.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..sources.shared import ship, stored

# Kinds that may be asked about and answered.
ASKED = ("text", "heading", "caption", "note")
MIN_CHARS, BATCH, LEAST = 12, 8, 0.5


class Client(Protocol):
    """A model: a task and a list of candidates to a JSON text."""

    def generate_json(self, task: str, payload: list[dict]) -> str: ...


@dataclass(frozen=True)
class Config:
    """Which enrichment runs, and how large its requests are."""

    mode: str = "baseline"
    batch: int = BATCH
    min_chars: int = MIN_CHARS

    @property
    def semantic(self) -> bool:
        return self.mode in ("semantic", "all")

    @property
    def content(self) -> bool:
        return self.mode in ("content", "all")


def semantic_candidates(ordered: DataFrame, stats: DataFrame) -> DataFrame:
    """Blocks that may have another kind, why, and what is suggested."""
    rows = ordered.filter(F.col("kind").isin(*ASKED) & (F.coalesce("text", F.lit("")) != "")).join(stats.select("doc_id", "page", "body_font_size"), ["doc_id", "page"], "left")
    ratio = F.when(F.col("body_font_size") > 0, G.height(G.box()) / F.col("body_font_size"))
    rows = rows.withColumn("ratio", ratio).withColumn("reason", T.hint_reason(F.col("kind"), F.col("label"), F.col("text"), F.col("ratio")))
    return rows.filter(F.col("reason").isNotNull()).select("doc_id", "id", "page", "kind", "text", "rpos", "reason", T.hint_kind(F.col("reason"), F.col("kind")).alias("hint"), F.length("text").alias("text_length"), F.length(T.signature(F.col("text"))).alias("n_signs"), "ratio")


def candidate_stats(ordered: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, eligible, included, skipped)."""
    eligible = ordered.filter(F.col("kind").isin(*ASKED) & (F.coalesce("text", F.lit("")) != "")).groupBy("doc_id").agg(F.count("*").alias("eligible"))
    got = candidates.groupBy("doc_id").agg(F.count("*").alias("included"))
    out = eligible.join(got, "doc_id", "left").withColumn("included", F.coalesce("included", F.lit(0)))
    return out.withColumn("skipped", F.col("eligible") - F.col("included"))


_DECISION = "array<struct<id:string,kind:string,heading_level:string,confidence:string>>"
_LINK = "array<struct<caption_id:string,target_id:string,confidence:string>>"
_REPAIR = "array<struct<node_id:string,text:string,confidence:string>>"


def first_json(text: str | None) -> str | None:
    """The first object or list in a text that is whole JSON."""
    decoder = json.JSONDecoder()
    for at, c in enumerate(text or ""):
        if c in "[{":
            try:
                return text[at : decoder.raw_decode(text, at)[1]]
            except (json.JSONDecodeError, RecursionError):
                continue
    return None


def unwrapped(answers: DataFrame) -> DataFrame:
    """Answers without the code fence or the words around their JSON. Only those
    that no parser takes as they are go to Python."""
    clean = F.regexp_replace(F.trim("answer"), r"(?is)^```(?:json)?\s*(.*?)\s*```$", "$1")

    @F.pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(first_json)

    ship(answers.sparkSession)
    rows = answers.withColumn("answer", clean)
    odd = F.try_parse_json(F.col("answer")).isNull() & F.col("answer").isNotNull()
    return rows.withColumn("_odd", F.when(odd, F.col("answer"))).withColumn("answer", F.when(odd, found("_odd")).otherwise(F.col("answer"))).drop("_odd")


def _parsed(answers: DataFrame, names: tuple[str, ...], kind: str) -> DataFrame:
    """The list under the first known name, or the whole answer if it is one;
    answers that hold no JSON give nothing."""
    keys = [c for c in ("doc_id", "request") if c in answers.columns]
    v = F.try_parse_json(F.col("answer"))
    found = F.coalesce(*[F.try_variant_get(v, f"$.{n}", kind) for n in names], F.try_variant_get(v, "$", kind))
    return unwrapped(answers).select(*keys, F.posexplode(found).alias("nth", "r")).select(*keys, "nth", "r.*")


def _number(c):
    x = F.expr(f"try_cast({c} AS DOUBLE)")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def parse_decisions(answers: DataFrame) -> DataFrame:
    """Sure decisions of known kinds; the last one for an id counts."""
    rows = _parsed(answers, ("semantic_decisions", "decisions", "blocks"), _DECISION).withColumn("confidence", _number("confidence"))
    rows = rows.filter((F.trim("id") != "") & F.col("kind").isin(*ASKED) & (F.col("confidence") >= LEAST))
    last = F.row_number().over(Window.partitionBy("doc_id", "id").orderBy(F.desc("nth")))
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.expr("try_cast(heading_level AS INT)")))
    level = F.when(F.expr("try_cast(heading_level AS INT)").isNotNull(), level)
    return rows.withColumn("_last", last).filter("_last = 1").select("doc_id", F.trim("id").alias("id"), "kind", level.alias("heading_level"), "confidence")


def parse_links(answers: DataFrame) -> DataFrame:
    rows = _parsed(answers, ("caption_links", "caption_candidate_repairs", "links"), _LINK).withColumn("confidence", _number("confidence"))
    rows = rows.filter((F.trim("caption_id") != "") & (F.trim("target_id") != "") & (F.col("confidence") >= LEAST))
    last = F.row_number().over(Window.partitionBy("doc_id", "target_id").orderBy(F.desc("nth")))
    return rows.withColumn("_last", last).filter("_last = 1").select("doc_id", "caption_id", "target_id", "confidence")


def parse_repairs(answers: DataFrame) -> DataFrame:
    rows = _parsed(answers, ("repairs", "content_repairs", "items"), _REPAIR).withColumn("confidence", _number("confidence"))
    rows = rows.filter((F.trim("node_id") != "") & (F.trim("text") != "") & (F.col("confidence") >= LEAST))
    last = F.row_number().over(Window.partitionBy("doc_id", "node_id").orderBy(F.desc("nth")))
    return rows.withColumn("_last", last).filter("_last = 1").select("doc_id", "node_id", F.col("text").alias("repair"), "confidence")


def matched_repairs(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, node_id, repair, confidence): what each request was answered. An
    answer counts for the nodes of its own request; where a request has one node
    and its answer one repair, that is the node's whatever it is called."""
    rows = _parsed(answers, ("repairs", "content_repairs", "items"), _REPAIR).withColumn("confidence", _number("confidence"))
    rows = rows.filter((F.trim("node_id") != "") & (F.trim("text") != "") & (F.col("confidence") >= LEAST))
    whole = Window.partitionBy("doc_id", "request")
    last = F.row_number().over(Window.partitionBy("doc_id", "request", "node_id").orderBy(F.desc("nth")))
    rows = rows.withColumn("_n", F.count("*").over(whole)).withColumn("_last", last).filter("_last = 1")
    rows = rows.select("doc_id", "request", F.col("node_id").alias("_id"), F.col("text").alias("repair"), "confidence", "_n")
    asked = candidates.select("doc_id", "request", "node_id").withColumn("_m", F.count("*").over(whole))
    own = asked.join(rows, ["doc_id", "request"]).filter((F.col("node_id") == F.col("_id")) | ((F.col("_m") == 1) & (F.col("_n") == 1)))
    return own.select("doc_id", "node_id", "repair", "confidence")


def apply_links(refs: DataFrame, elements: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References with the captions that links give them, and links to captions
    that no element is, which change nothing.

    ``refs`` has (doc_id, ref_id, caption_id). The last link of a target to a
    known caption counts; ``links`` are those of ``all_links``. The first result
    adds ``relinked``, whether the caption is another than before."""
    known = elements.select("doc_id", F.col("id").alias("caption_id"))
    unknown = links.join(known, ["doc_id", "caption_id"], "left_anti").select("doc_id", "nth", "caption_id", "target_id")
    good = links.join(known, ["doc_id", "caption_id"], "left_semi")
    last = good.groupBy("doc_id", F.col("target_id").alias("ref_id")).agg(F.max_by("caption_id", "nth").alias("_new"))
    rows = refs.join(last, ["doc_id", "ref_id"], "left")
    now = F.coalesce("_new", "caption_id")
    return rows.withColumn("relinked", ~now.eqNullSafe(F.col("caption_id"))).withColumn("caption_id", now).drop("_new"), unknown


def all_links(answers: DataFrame) -> DataFrame:
    """(doc_id, nth, caption_id, target_id, confidence): sure links, as answered."""
    rows = _parsed(answers, ("caption_links", "caption_candidate_repairs", "links"), _LINK).withColumn("confidence", _number("confidence"))
    rows = rows.filter((F.trim("caption_id") != "") & (F.trim("target_id") != "") & (F.col("confidence") >= LEAST))
    return rows.select("doc_id", "nth", "caption_id", "target_id", "confidence")


def apply_decisions(elements: DataFrame, decisions: DataFrame) -> DataFrame:
    """Elements with the decided kind, the kind before and the level's hint."""
    d = decisions.select("doc_id", "id", F.col("kind").alias("_kind"), F.col("heading_level").alias("llm_heading_level"))
    rows = elements.join(d, ["doc_id", "id"], "left")
    return rows.withColumn("original_kind", F.when(F.col("_kind").isNotNull(), F.col("kind"))).withColumn("kind", F.coalesce("_kind", "kind")).drop("_kind")


def unknown_ids(elements: DataFrame, decisions: DataFrame) -> DataFrame:
    """(doc_id, ids): decided ids that no element has, sorted."""
    lost = decisions.join(elements.select("doc_id", "id"), ["doc_id", "id"], "left_anti")
    return lost.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("ids"))


def repair_candidates(nodes: DataFrame, min_chars: int = MIN_CHARS, batch: int = BATCH) -> DataFrame:
    """Texts that a model may repair, with their request: not english (rules do
    that), nothing with links, code or tables, and long enough. ``nodes`` has
    (doc_id, node_id, pos, text)."""
    rows = nodes.withColumn("language", T.language(F.col("text")))
    rows = rows.filter((F.coalesce(F.trim("text"), F.lit("")) != "") & ~T.skips_repair(F.col("text")) & (F.col("language") != "english") & (F.length(T.signature(F.col("text"))) >= min_chars))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    return rows.withColumn("request", F.floor(nth / batch).cast("int"))


def ask(candidates: DataFrame, client: Callable[[], Client], task: str, columns: tuple[str, ...], batch: int = BATCH) -> DataFrame:
    """(doc_id, request, answer, failure): requests of ``batch`` candidates of one
    document.

    The client is made once per Python worker. A request that fails has no answer
    but a failure, and the texts stay as they are."""
    ship(candidates.sparkSession)
    rows = F.array_sort(F.collect_list(F.struct(*columns)))
    asked = candidates.groupBy("doc_id", "request").agg(F.to_json(rows).alias("payload"))
    kind = candidates.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        model = client()
        for pdf in batches:
            answers, failures = [], []
            for payload in pdf["payload"]:
                answer = failure = None
                try:
                    answer = model.generate_json(task, json.loads(payload))
                except Exception as e:  # any failure of a model leaves the text alone and is counted
                    failure = f"{type(e).__name__}: {e}"
                answers.append(answer)
                failures.append(failure)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "request": pdf["request"], "answer": answers, "failure": failures})

    return asked.select("doc_id", "request", "payload").mapInPandas(run, f"doc_id {kind}, request int, answer string, failure string")


def repaired(nodes: DataFrame, candidates: DataFrame, repairs: DataFrame) -> DataFrame:
    """Nodes with ``new_text`` and ``outcome``: rule (english hyphenation),
    applied, unchanged, discarded (signs other than blanks would change), kept."""
    c = candidates.select("doc_id", "node_id", F.lit(True).alias("_asked"))
    rows = nodes.join(c, ["doc_id", "node_id"], "left").join(repairs.select("doc_id", "node_id", "repair"), ["doc_id", "node_id"], "left")
    text, repair = F.col("text"), F.col("repair")
    open_ = (F.coalesce(F.trim(text), F.lit("")) != "") & ~T.skips_repair(text)
    english = open_ & (T.language(text) == "english")
    same = T.signature(text) == T.signature(repair)
    outcome = (
        F.when(english & (T.without_hyphenation(text) != text), "rule")
        .when(~open_ | english | F.col("_asked").isNull() | repair.isNull(), "kept")
        .when(~same, "discarded").when(repair != text, "applied").otherwise("unchanged")
    )
    rows = rows.withColumn("outcome", outcome)
    new = F.when(F.col("outcome") == "rule", T.without_hyphenation(text)).when(F.col("outcome") == "applied", repair).otherwise(text)
    return rows.withColumn("new_text", new).drop("_asked", "repair")


SEMANTIC, CONTENT = "semantic_repair", "content_repair"


def _warning(rows: DataFrame, code: str, ids, detail) -> DataFrame:
    return rows.select("doc_id", F.lit(code).alias("code"), ids.alias("ids"), detail.cast("string").alias("detail"))


def enrich_semantics(elements: DataFrame, stats: DataFrame, refs: DataFrame, client: Callable[[], Client], config: Config) -> dict[str, DataFrame]:
    """elements, refs, warnings and counts after a model has been asked about
    kinds and captions. Without the mode nothing is asked and nothing changes; a
    document without candidates is not asked about.

    ``refs`` has (doc_id, ref_id, caption_id). Counts, for each document asked
    about: candidates, requests, failed, decided, unknown, changed, relinked.
    """
    none = elements.select("doc_id", F.lit("").alias("code"), F.lit("").alias("ids"), F.lit("").alias("detail")).filter("false")
    if not config.semantic:
        return {"elements": elements, "refs": refs, "warnings": none, "counts": elements.select("doc_id").filter("false")}
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("rpos")) - 1
    asked = semantic_candidates(elements, stats).withColumn("request", F.floor(nth / config.batch).cast("int"))
    columns = ("rpos", "id", "kind", "text", "reason", "hint", "page")
    answers = stored(ask(asked, client, SEMANTIC, columns, config.batch), "semantic-answers")
    decisions = stored(parse_decisions(answers.drop("request")), "decisions")
    links, lost = apply_links(refs, elements, all_links(answers.drop("request")))
    strange = decisions.join(elements.select("doc_id", "id"), ["doc_id", "id"], "left_anti")
    now = apply_decisions(elements, decisions)
    warnings = _warning(answers.filter("failure is not null"), "llm_semantic_failed", F.lit(""), F.col("failure"))
    warnings = warnings.unionByName(_warning(unknown_ids(elements, decisions), "llm_unknown_block", F.col("ids"), F.lit(None)))
    warnings = warnings.unionByName(_warning(lost, "llm_caption_link_unknown_caption", F.col("caption_id"), F.col("target_id")))
    per = lambda rows, name: rows.groupBy("doc_id").agg(F.count("*").alias(name))
    counts = per(asked, "candidates").join(answers.groupBy("doc_id").agg(F.count("*").alias("requests"), F.count("failure").alias("failed")), "doc_id", "left")
    changed = now.filter(F.col("original_kind").isNotNull() & (F.col("original_kind") != F.col("kind")))
    for rows, name in ((decisions, "decided"), (strange, "unknown"), (changed, "changed"), (links.filter("relinked"), "relinked")):
        counts = counts.join(per(rows, name), "doc_id", "left")
    return {"elements": now, "refs": links, "warnings": warnings, "counts": counts.na.fill(0)}


def outcome_counts(rows: DataFrame, candidates: DataFrame, matched: DataFrame, answers: DataFrame) -> DataFrame:
    """For each document of ``rows`` (the result of ``repaired``): candidates,
    requests, failed, parsed, matched, missing, rule, applied, unchanged, discarded."""
    o = F.col("outcome")
    out = rows.groupBy("doc_id").agg(F.count_if(o == "rule").alias("rule"), F.count_if(o.isin("rule", "applied")).alias("applied"), F.count_if(o == "unchanged").alias("unchanged"), F.count_if(o == "discarded").alias("discarded"))
    asked = candidates.groupBy("doc_id").agg(F.count("*").alias("candidates"))
    said = answers.groupBy("doc_id").agg(F.count("*").alias("requests"), F.count("failure").alias("failed"))
    got = matched.groupBy("doc_id").agg(F.count("*").alias("matched"))
    parsed = parse_repairs(answers).groupBy("doc_id").agg(F.count("*").alias("parsed"))
    for more in (asked, said, parsed, got):
        out = out.join(more, "doc_id", "left")
    return out.na.fill(0).withColumn("missing", F.col("candidates") - F.col("matched"))


def repair_contents(nodes: DataFrame, client: Callable[[], Client], config: Config) -> dict[str, DataFrame]:
    """nodes, warnings and counts after a model has been asked to mend texts that
    rules do not; english texts are mended by rule. A repair that changes more
    than blanks is discarded with a warning, and a failed request warns too."""
    none = nodes.select("doc_id", F.lit("").alias("code"), F.lit("").alias("ids"), F.lit("").alias("detail")).filter("false")
    if not config.content:
        return {"nodes": nodes.withColumn("outcome", F.lit("kept")).withColumn("new_text", F.col("text")), "warnings": none, "counts": nodes.select("doc_id").filter("false")}
    asked = repair_candidates(nodes, config.min_chars, config.batch)
    answers = stored(ask(asked, client, CONTENT, ("pos", "node_id", "text", "language"), config.batch), "content-answers")
    matched = stored(matched_repairs(asked, answers), "repairs")
    now = stored(repaired(nodes, asked, matched), "repaired")
    warnings = _warning(answers.filter("failure is not null"), "llm_content_failed", F.lit(""), F.col("failure"))
    warnings = warnings.unionByName(_warning(now.filter("outcome = 'discarded'"), "llm_content_preservation_failed", F.col("node_id"), F.lit(None)))
    return {"nodes": now, "warnings": warnings, "counts": outcome_counts(now, asked, matched, answers)}
