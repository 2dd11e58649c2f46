"""Logs of events: order and pruning of chunks, repair, registries, envelopes, replays and fetch plans.

An event is (sequence_num, event_type, timestamp_utc, payload, ...), its payload
JSON text. Null keys are left out of folds; empty logs give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hierarchy as H
from .dedup import best_status
from .events import latest_per_key
from .reshape import ordinal

# The kinds of events with the fields of their payloads.
PAYLOADS = {
    "query_response": ["endpoint", "normalized_query", "source_step", "status", "key", "http_status", "error"],
    "entity_discovered": ["qid", "label", "source_step", "discovery_method"],
    "entity_expanded": ["qid", "label", "expansion_type", "inlink_count", "outlink_count"],
    "expansion_decision": ["qid", "label", "decision", "decision_reason", "eligibility"],
    "triple_discovered": ["subject_qid", "predicate_pid", "object_qid", "source_step"],
    "class_membership_resolved": ["entity_qid", "class_id", "path_to_core_class", "subclass_of_core_class", "is_class_node"],
    "eligibility_transition": ["entity_qid", "previous_eligible", "current_eligible", "previous_reason", "current_reason", "path_to_core_class"],
    "relevance_assigned": ["entity_qid", "relevant", "assignment_type", "relevant_seed_source"],
    "entity_fetched": ["qid", "label", "depth", "triple_count", "description", "aliases"],
    "entity_basic_fetched": ["qid", "label", "p31_qids", "p279_qids", "source"],
    "class_resolved": ["class_qid", "parent_qids", "depth", "core_class_qid"],
    "entity_marked_relevant": ["qid", "core_class_qid", "via_rule", "source_seed_qid"],
    "fetch_decision": ["qid", "decision", "reason", "subject_qid", "predicate_pid", "depth"],
    "rule_changed": ["rule_file", "rule_hash"],
}


def build_events(rows: DataFrame, event_type: str, time: Column, order: list[str], start: int = 0, version: str = "v4") -> DataFrame:
    """Envelopes around rows: the payload has the fields of the kind that the rows have, numbers without gaps in the given order."""
    from ..sources.sinks import number_events

    fields = [c for c in PAYLOADS[event_type] if c in rows.columns]
    body = F.to_json(F.struct(*[F.col(c) for c in fields]), {"ignoreNullFields": "false"})
    d = number_events(rows, order, start)
    return d.select("sequence_num", F.lit(version).alias("event_version"), F.lit(event_type).alias("event_type"), time.alias("timestamp_utc"), body.alias("payload"))


def chunk_order(chunks: DataFrame) -> DataFrame:
    """(chunk_id, position): along the links from the first chunk, then those the links miss by first sequence.

    chunks (chunk_id, prev_chunk_id, first_sequence). The first chunk is the one of
    least first sequence that names no earlier one.
    """
    none = chunks.select(F.col("chunk_id").alias("node")).limit(0)
    place = H.resolve(chunks.select(F.col("chunk_id").alias("node"), F.col("prev_chunk_id").alias("parent")), none, keep_paths=False)
    d = chunks.join(place, F.col("chunk_id") == F.col("node"))
    start = d.where("depth = 0 AND prev_chunk_id IS NULL").agg(F.min(F.struct("first_sequence", "chunk_id")).alias("s")).select(F.col("s.chunk_id").alias("start"))
    d = d.crossJoin(F.broadcast(start))  # one row
    linked = (F.col("root") == F.col("start")) & (F.col("depth") >= 0)
    rank = [F.when(linked, 0).otherwise(1), F.when(linked, F.col("depth")), F.col("first_sequence"), F.col("chunk_id")]
    return d.select("chunk_id", F.row_number().over(Window.orderBy(*rank)).cast("long").alias("position"))  # as many rows as files


def chunks_from(catalog: DataFrame, sequence: int) -> DataFrame:
    """(chunk): the chunks that may hold events from a sequence number on: a chunk whose next one begins at or before it cannot."""
    nxt = F.lead("first_seq").over(Window.orderBy("first_seq"))  # as many rows as chunks
    return catalog.select("chunk", nxt.alias("n")).where(F.col("n").isNull() | (F.col("n") > sequence)).select("chunk")


def events_from(log: DataFrame, catalog: DataFrame, chunk: str, seq: str, sequence: int) -> DataFrame:
    """Events from a sequence number on, read from the chunks that may hold some: the scan of a log partitioned by chunk prunes the others."""
    return log.join(F.broadcast(chunks_from(catalog, sequence).withColumnRenamed("chunk", chunk)), chunk, "left_semi").where(F.col(seq) >= sequence)  # chunks are files


def chunk_status(log: DataFrame, chunk: str, seq: str, time: str, kind: str, closing: str) -> DataFrame:
    """(chunk, first_seq, last_seq, status, opened, closed): a chunk is closed if its last event says so; ``closed`` is then that event's time."""
    g = log.groupBy(F.col(chunk).alias("chunk")).agg(F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.min(time).alias("opened"), F.max(F.struct(F.col(seq).alias("q"), F.col(kind).alias("k"), F.col(time).alias("t"))).alias("s"))
    shut = F.col("s.k") == closing
    return g.select("chunk", "first_seq", "last_seq", F.when(shut, "closed").otherwise("open").alias("status"), "opened", F.when(shut, F.col("s.t")).alias("closed"))


def validate_checksums(registered: DataFrame, current: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """(path, state): ``ok``, ``changed``, ``missing`` (no file) or ``unregistered``."""
    r, c = registered.select(key, F.col(digest).alias("_r")), current.select(key, F.col(digest).alias("_c"))
    state = F.when(F.col("_c").isNull(), "missing").when(F.col("_r").isNull(), "unregistered").when(F.col("_r") == F.col("_c"), "ok").otherwise("changed")
    return r.join(c, key, "full").select(key, state.alias("state"))


def progress(registry: DataFrame, runs: DataFrame, managed: list[str]) -> DataFrame:
    """(handler, last_sequence): the registry with the runs' sequences, never going back; handlers that are not managed any more go."""
    both = registry.select("handler", "last_sequence").unionByName(runs.select("handler", "last_sequence"))
    return both.where(F.col("handler").isin(managed)).groupBy("handler").agg(F.max("last_sequence").alias("last_sequence"))


def drop_partial_tail(lines: DataFrame, file: str, line: str, value: str) -> DataFrame:
    """The lines without a last line of a file that is no whole JSON object, as a crash leaves it; damage elsewhere stays."""
    last = lines.groupBy(file).agg(F.max(line).alias("_l"))
    whole = F.coalesce(F.try_parse_json(F.col(value)).isNotNull() & F.trim(value).startswith("{"), F.lit(False))
    return lines.join(last, file).where((F.col(line) < F.col("_l")) | whole).drop("_l")


def batches(df: DataFrame, group: list[str], order: list, size: int = 100) -> DataFrame:
    """``batch_no``: every ``size`` rows of a group, in order, are written together; what is left over at a read is the last batch."""
    return ordinal(df, group, order, "_o").withColumn("batch_no", F.floor(F.col("_o") / size).cast("long")).drop("_o")


def bootstrap(snapshot: DataFrame, log: DataFrame, key: list[str], seq: str, keep: list[str], upto: int) -> DataFrame:
    """State after the log, from a snapshot of it up to a sequence number and only the events after that."""
    return latest_per_key(snapshot.select(*key, seq, *[c for c in keep if c != seq]).unionByName(log.where(F.col(seq) > upto).select(*key, seq, *[c for c in keep if c != seq])), key, seq, keep)


def candidates(log: DataFrame, mention: str, candidate: str, seq: str) -> DataFrame:
    """(mention, candidate, first_seq): each pair once, when it was first proposed."""
    return log.where(F.col(mention).isNotNull() & F.col(candidate).isNotNull()).groupBy(mention, candidate).agg(F.min(seq).alias("first_seq"))


def last_success(log: DataFrame, key: str, seq: str, ok: Column, keep: list[str]) -> DataFrame:
    """Of each key the last event that succeeded; keys that never did have no row."""
    return latest_per_key(log.where(ok), [key], seq, keep)


def config_changes(files: DataFrame, registered: DataFrame) -> DataFrame:
    """(name, digest): files (name, content) whose content is not the one last registered (name, digest, sequence_num); registering again changes nothing."""
    last = latest_per_key(registered, ["name"], "sequence_num", ["digest"]).withColumnRenamed("digest", "_d")
    now = files.select("name", F.md5("content").alias("digest"))
    return now.join(last, "name", "left").where(F.col("_d").isNull() | (F.col("_d") != F.col("digest"))).select("name", "digest")


def run_handlers(log: DataFrame, seq: str, handlers: dict[str, Callable[[DataFrame], DataFrame]], done: DataFrame, full: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """(results, summary): every handler over the events after its own last sequence, or over all.

    done (handler, last_sequence). The summary (handler, mode, events,
    last_sequence) is one aggregate a handler; a handler without new events keeps its place.
    """
    last = {r["handler"]: r["last_sequence"] for r in done.collect()}  # as many rows as handlers
    out, rows = {}, None
    for name, handle in handlers.items():
        after = -1 if full else last.get(name, -1)
        new = log.where(F.col(seq) > after)
        out[name] = handle(new)
        one = new.agg(F.count("*").alias("events"), F.coalesce(F.max(seq), F.lit(after)).alias("last_sequence"))
        one = one.select(F.lit(name).alias("handler"), F.lit("full" if full or name not in last else "incremental").alias("mode"), "events", F.col("last_sequence").cast("long").alias("last_sequence"))
        rows = one if rows is None else rows.unionByName(one)
    return out, rows


def known_urls(log: DataFrame, group: Column, url: str, extracted: Column) -> DataFrame:
    """(grp, known, extracted): per programme how many addresses are known and how many of them have been extracted."""
    d = log.where(F.col(url).isNotNull()).groupBy(group.alias("grp"), url).agg(F.max(F.coalesce(extracted, F.lit(False)).cast("int")).alias("x"))
    return d.groupBy("grp").agg(F.count("*").alias("known"), F.sum("x").cast("long").alias("extracted"))


def fetch_plan(wanted: DataFrame, cache: DataFrame, key: str, time: str, now: Column, max_days: int = 365, batch: int = 50) -> DataFrame:
    """(key, action, batch_no): from the cache unless it is older than ``max_days``, else fetched, in batches ordered by id."""
    last = cache.groupBy(key).agg(F.max(time).alias("_t"))
    d = wanted.select(key).where(F.col(key).isNotNull()).distinct().join(last, key, "left").withColumn("action", F.when(F.datediff(now, F.col("_t")) <= max_days, "cache").otherwise("fetch"))
    out = batches(d.where("action = 'fetch'").select(key, "action"), ["action"], [key], batch)
    return out.unionByName(d.where("action = 'cache'").select(key, "action", F.lit(None).cast("long").alias("batch_no")))


def tail(log: DataFrame, seq: str, after: int, phase: Column, backoff: Column) -> DataFrame:
    """(events, calls, backoffs, last_seq) of one phase since a place in the log: one pass over what is new."""
    return log.where(F.col(seq) > after).agg(F.count("*").alias("events"), F.count_if(phase).alias("calls"), F.count_if(phase & backoff).alias("backoffs"), F.max(seq).alias("last_seq"))


def inventory_after(state: DataFrame, new: DataFrame, key: list[str], rank: Column, time: str, keep: list[str]) -> DataFrame:
    """The inventory of queries after further events: the best status, then the latest, as if all had been read at once."""
    cols = list(dict.fromkeys([*key, time, *keep]))
    return best_status(state.select(*cols).unionByName(new.select(*cols)), key, rank, time, keep)


def query_hash(endpoint: Column, query: Column) -> Column:
    """md5 of endpoint and query, the query with single blanks."""
    return F.md5(F.concat_ws("|", endpoint, F.trim(F.regexp_replace(query, r"[ \t\r\n]+", " "))))


def migrate(log: DataFrame, envelope: list[str], version: str = "v3") -> DataFrame:
    """Flat events as enveloped ones: all columns but those of the envelope go into ``payload``, an absent ``query_hash`` is filled in."""
    rest = [c for c in log.columns if c not in envelope and c != "query_hash"]
    h = F.coalesce(F.col("query_hash") if "query_hash" in log.columns else F.lit(None).cast("string"), query_hash(F.col("endpoint"), F.col("normalized_query")))
    return log.select(*envelope, F.lit(version).alias("event_version"), h.alias("query_hash"), F.to_json(F.struct(*rest)).alias("payload"))


def entities_in_events(log: DataFrame, seq: str, payload: str) -> DataFrame:
    """(qid, sequence_num, document): the documents of all events that carry some, under ``entities`` by id."""
    docs = F.from_json(F.get_json_object(payload, "$.entities"), "map<string,string>")
    return log.select(F.col(seq).alias("sequence_num"), F.explode(docs).alias("qid", "document"))


def seed_registry(log: DataFrame, key: str, seq: str, keep: list[str]) -> DataFrame:
    """(key, first_seq, ...): each seed once, with its last registration and when it was first registered."""
    return log.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(seq).alias("first_seq"), F.max(F.struct(F.col(seq).alias("_q"), *keep)).alias("_s")).select(key, "first_seq", *[F.col(f"_s.{c}") for c in keep])


def dotted(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, value): the leaves of nested JSON under names of the steps joined by dots; places in lists are numbers."""
    from . import nested as N

    tr = N.triples(df, key, text, r"(?!)", []).where("value IS NOT NULL")
    name = F.aggregate("ord", F.col("path"), lambda acc, o: F.regexp_replace(acc, F.lit(r"^([^\[]*)\[\]"), F.concat(F.lit("$1."), o)))
    return tr.select(key, name.alias("name"), "value")


def chunk_index(store: DataFrame, key: str, per_chunk: int = 1000) -> DataFrame:
    """(key, chunk, place): where each entity of a store ordered by id lies, for point lookups that read one chunk."""
    d = ordinal(store.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_g", F.lit(0)), ["_g"], [key], "_o")
    return d.select(key, F.floor(F.col("_o") / per_chunk).cast("long").alias("chunk"), (F.col("_o") % per_chunk).cast("long").alias("place"))


def work_queue(tasks: DataFrame, kind: str, seq: str, depth: str, kinds: list[str], max_depth: int) -> DataFrame:
    """``position`` of each task: kinds in their order, first come first served within one; tasks deeper than allowed are not queued."""
    from .stats import running

    rank = F.array_position(F.lit(kinds), F.col(kind))
    d = tasks.where((rank > 0) & (F.col(depth) <= max_depth)).withColumn("_k", rank).withColumn("_one", F.lit(1))
    return running(d, [F.asc("_k"), F.asc(seq)], "_one").withColumnRenamed("rank", "position").drop("_k", "_one", "running", "cumulative_pct")


def parity(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(side, n): rows both runs gave alike, and rows that only one gave, by all columns."""
    a, b = old.select(*new.columns), new
    n = lambda df, s: df.agg(F.count("*").alias("n")).select(F.lit(s).alias("side"), "n")
    return n(a.intersectAll(b), "same").unionByName(n(a.exceptAll(b), "only_old")).unionByName(n(b.exceptAll(a), "only_new"))
