"""Joins and set comparisons between notes, children, ledgers, manifests and registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgate.functions.base import bind, is_blank, strip, text
from corpusgate.functions.text import TAG, ascii_terms, media_refs
from corpusgate.operators.notes import tail_digest, tail_populated
from corpusgate.functions import values as V


def _keys(df: DataFrame, key: str, name: str = "_k") -> DataFrame:
    """Distinct keys; the map-side combine removes hot keys before they travel."""
    return df.select(F.col(key).alias(name)).distinct()


# ---- J1..J3, A1 ---------------------------------------------------------------------------

def orphan_children(children: DataFrame, parents: DataFrame, child_key: str,
                    parent_key: str) -> DataFrame:
    """Child rows whose parent is missing."""
    known = parents.select(F.col(parent_key).alias("_k"))
    return children.join(known, children[child_key] == F.col("_k"), "left_anti")


def childless_parents(parents: DataFrame, children: DataFrame, parent_key: str,
                      child_key: str) -> DataFrame:
    """Parent rows without any child."""
    return parents.join(_keys(children, child_key), parents[parent_key] == F.col("_k"),
                        "left_anti")


def bad_reference(rows: DataFrame, dim: DataFrame, key: str, dim_key: str) -> DataFrame:
    """Rows with `key NOT IN (dim)`: a null in the dimension hides every row, and a null
    key counts only against an empty dimension. Written without NOT IN, which would
    broadcast the dimension whatever its size."""
    has_null = dim.where(F.col(dim_key).isNull()).exists()
    is_empty = ~dim.select(F.lit(1)).exists()
    known = _keys(dim.where(F.col(dim_key).isNotNull()), dim_key)
    named = (rows.where(F.col(key).isNotNull() & ~has_null)
             .join(known, F.col(key) == F.col("_k"), "left_anti"))
    return named.unionByName(rows.where(F.col(key).isNull() & is_empty))


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Key groups with more than one row, and their size."""
    return (rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))


def integrity_gate(notes: DataFrame, cards: DataFrame, decks: DataFrame,
                   notetypes: DataFrame) -> DataFrame:
    """(gate, value, pass) of the five structural counts."""
    checks = [
        ("orphan cards", orphan_children(cards, notes, "nid", "nid")),
        ("notes with no card", childless_parents(notes, cards, "nid", "nid")),
        ("duplicate guids", duplicate_keys(notes, "guid")),
        ("bad notetype ref", bad_reference(notes, notetypes, "mid", "mid")),
        ("bad deck ref", bad_reference(cards, decks, "did", "did")),
    ]
    return gate_counts(checks)


def gate_counts(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """One (gate, value, pass) row per named set of offending rows."""
    out = None
    for name, df in checks:
        row = df.agg(F.count(F.lit(1)).alias("value")).select(
            F.lit(name).alias("gate"), "value", (F.col("value") == 0).alias("pass"))
        out = row if out is None else out.unionByName(row)
    return out


# ---- J4..J6, E4 -----------------------------------------------------------------------------

def pair_by_key(sources: DataFrame, decks: DataFrame, key: str = "key") -> DataFrame:
    """Full outer pairing: matched decks are built in full, decks alone are optimised,
    sources alone are only reported."""
    s = sources.select(key, F.lit(True).alias("_s"),
                       *[c for c in sources.columns if c != key])
    d = decks.select(key, F.lit(True).alias("_d"), *[c for c in decks.columns if c != key])
    mode = (F.when(F.col("_s") & F.col("_d"), "full")
            .when(F.col("_d"), "optimize-only").otherwise("source-only"))
    return s.join(d, key, "full").withColumn("mode", mode).drop("_s", "_d")


def priority_match(wanted: DataFrame, candidates: DataFrame) -> DataFrame:
    """(key, path, via): match by file-name key, else by inner-name key; first by name.

    `candidates` has (file_key, inner_key, path).
    """
    by_file = candidates.groupBy(F.col("file_key").alias("key")).agg(F.min("path").alias("_f"))
    by_inner = candidates.groupBy(F.col("inner_key").alias("key")).agg(F.min("path").alias("_i"))
    return (wanted.join(by_file, "key", "left").join(by_inner, "key", "left")
            .select(*wanted.columns, F.coalesce("_f", "_i").alias("path"),
                    F.when(F.col("_f").isNotNull(), "file")
                    .when(F.col("_i").isNotNull(), "inner").alias("via")))


def exclude_tracked(candidates: DataFrame, registry: DataFrame, key: str,
                    tracked_key: str) -> DataFrame:
    """Candidates that the registry does not know, whatever their status there."""
    return candidates.join(_keys(registry, tracked_key),
                           candidates[key] == F.col("_k"), "left_anti")


def key_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) with side both, left or right."""
    l, r = _keys(left, key, key), _keys(right, key, key)
    side = (F.when(F.col("_l") & F.col("_r"), "both")
            .when(F.col("_l"), "left").otherwise("right"))
    return (l.withColumn("_l", F.lit(True)).join(r.withColumn("_r", F.lit(True)), key, "full")
            .select(key, side.alias("side")))


# ---- J7, J8 -----------------------------------------------------------------------------------

def untouched_notes(ledger: DataFrame, ops: DataFrame) -> DataFrame:
    return ledger.join(_keys(ops, "nid"), ledger["nid"] == F.col("_k"), "left_anti")


def reconcile_ledger(ledger: DataFrame, ops: DataFrame, added: DataFrame) -> DataFrame:
    """One row: notes, touched, untouched, flagged_untouched, added."""
    left = untouched_notes(ledger, ops).agg(
        F.count(F.lit(1)).alias("untouched"),
        F.count_if(F.col("n_flags") > 0).alias("flagged_untouched"))
    notes = ledger.agg(F.count(F.lit(1)).alias("n")).scalar()
    touched = _keys(ops, "nid").agg(F.count(F.lit(1)).alias("n")).scalar()
    new = added.agg(F.count(F.lit(1)).alias("n")).scalar()
    return left.select(notes.alias("notes"), touched.alias("touched"), "untouched",
                       "flagged_untouched", new.alias("added"))


def new_collisions(collisions: DataFrame, baseline: DataFrame) -> DataFrame:
    """Collision keys that the baseline does not list."""
    return collisions.join(baseline.select("subject", "attribute").distinct(),
                           ["subject", "attribute"], "left_anti")


# ---- J14, J15, C8 --------------------------------------------------------------------------------

def tail_survival(before: DataFrame, after: DataFrame) -> DataFrame:
    """(nid, fields): populated tails that no surviving note carries any more."""
    held = before.where(F.size(tail_populated()) > 0).select(
        "nid", F.array_join(tail_populated(), ", ").alias("fields"),
        tail_digest().alias("_tail"))
    live = after.select(tail_digest().alias("_tail")).distinct()
    return held.join(live, "_tail", "left_anti").drop("_tail")


def note_media(notes: DataFrame) -> DataFrame:
    """(nid, ref): media names of a note, over all seven fields."""
    packed = F.concat_ws(V.FIELD_SEP, *[text(c) for c in V.NOTE_FIELDS])
    return notes.select("nid", F.explode(media_refs(packed)).alias("ref"))


def media_survival(before: DataFrame, after: DataFrame,
                   allowed: DataFrame | None = None) -> DataFrame:
    """(ref, owners, n_owners): media nobody points at any more.

    A name is excused only when every former owner opted out. The first four owners are
    kept by rank, so a name shared by many notes never becomes one large list.
    """
    gone = (note_media(before)
            .join(note_media(after).select("ref").distinct(), "ref", "left_anti"))
    if allowed is None:
        marked = gone.withColumn("_ok", F.lit(False))
    else:
        yes = _keys(allowed, "nid")
        marked = gone.join(yes, gone["nid"] == F.col("_k"), "left").withColumn(
            "_ok", F.col("_k").isNotNull()).drop("_k")
    sizes = (marked.groupBy("ref").agg(F.count(F.lit(1)).alias("n_owners"),
                                       F.bool_and("_ok").alias("_all")).where(~F.col("_all")))
    first = Window.partitionBy("ref").orderBy("nid")
    named = (marked.select("ref", "nid").withColumn("_r", F.row_number().over(first))
             .where("_r <= 4").groupBy("ref")
             .agg(F.sort_array(F.collect_list("nid")).alias("_o")))
    owners = F.array_join(F.transform("_o", lambda n: n.cast("string")), ", ")
    return sizes.join(named, "ref").select("ref", owners.alias("owners"), "n_owners")


def distinct_media(notes: DataFrame) -> DataFrame:
    return note_media(notes).agg(F.count_distinct("ref").alias("n_media"))


def preservation_gate(before: DataFrame, after: DataFrame, ops: DataFrame,
                      kinds: DataFrame) -> DataFrame:
    """(nid, ref, problem): losses that no op accounts for.

    `kinds` holds the applied change of each note: (nid, kind).
    """
    held = before.where(F.size(tail_populated()) > 0).select(
        "nid", F.array_join(tail_populated(), ", ").alias("_fields"),
        tail_digest().alias("_tail"))
    now = after.select(F.col("nid").alias("_nid"), tail_digest().alias("_now"))
    excused = ops.where("drop_tail").select(F.col("nid").alias("_x")).distinct()
    latest = kinds.select(F.col("nid").alias("_kn"), "kind")
    at_risk = (held.join(now, held["nid"] == F.col("_nid"), "left")
               .where(F.col("_now").isNull() | (F.col("_now") != F.col("_tail")))
               .join(excused, F.col("nid") == F.col("_x"), "left")
               .where(F.col("_nid").isNotNull() | F.col("_x").isNull())
               .join(latest, F.col("nid") == F.col("_kn"), "left"))
    live = after.select(tail_digest().alias("_tail")).distinct().withColumn("_l", F.lit(True))
    kind = F.lower(F.col("kind"))
    message = (
        F.when(F.col("_nid").isNotNull(), F.concat(
            F.col("_fields"), F.lit(" changed or was blanked by a "),
            F.coalesce(kind, F.lit("write"))))
        .when(kind == "split", F.concat(
            F.lit("split did not carry "), F.col("_fields"),
            F.lit(" onto any replacement note")))
        .otherwise(F.concat(F.coalesce(kind, F.lit("removal")), F.lit(" would destroy "),
                            F.col("_fields"))))
    tails = (at_risk.join(live, "_tail", "left")
             .where(~((F.coalesce(kind, F.lit("")) == "split") & F.col("_nid").isNull()
                      & F.col("_l").isNotNull()))
             .select("nid", F.lit(None).cast("string").alias("ref"), message.alias("problem")))
    lost = media_survival(before, after, ops.where("drop_media").select("nid"))
    media = lost.select(
        F.lit(None).cast("bigint").alias("nid"), "ref",
        F.concat(F.lit("no longer referenced, was on "), F.col("owners"),
                 F.when(F.col("n_owners") > 4, F.lit("...")).otherwise(F.lit("")))
        .alias("problem"))
    return tails.unionByName(media)


# ---- J16, J17 ----------------------------------------------------------------------------------

def insert_key(c="text") -> Column:
    """Identity of a front for duplicate inserts: no tags, trimmed, lower case."""
    return F.sha2(F.lower(strip(F.regexp_replace(text(c), TAG, ""))), 256)


def dedupe_inserts(new: DataFrame, existing: DataFrame, seq: str = "seq") -> DataFrame:
    """Adds kind ADD or DUPE-SKIP: a new note counts once, and only if it is not there yet.

    The first row of each key is found by a combinable minimum, not by sorting the
    copies, so thousands of copies of one text stay cheap.
    """
    keyed = new.withColumn("_key", insert_key())
    # Only keys of the batch matter; a small one is broadcast by its measured size, and the
    # corpus is then not shuffled.
    known = existing.select(insert_key().alias("_key")).join(
        keyed.select("_key").distinct(), "_key", "left_semi").distinct()
    first = (keyed.groupBy("_key").agg(F.min(seq).alias("_first"))
             .join(known, "_key", "left_anti")
             .select(F.col("_first"), F.lit("ADD").alias("kind")))
    return (keyed.join(first, keyed[seq] == F.col("_first"), "left")
            .withColumn("kind", F.coalesce("kind", F.lit("DUPE-SKIP")))
            .drop("_key", "_first"))


def missing_terms(source_body: Column, carried: Column, min_len: int = 6) -> Column:
    """Terms of a retiring note that do not occur, even inside a word, in what is kept.

    A term is letters only, so it can only occur inside a run of letters: terms that are a run
    themselves are found by hash, and only the others are looked for, in the distinct runs.
    """
    terms = ascii_terms(F.regexp_replace(source_body, TAG, " "), min_len)
    kept = F.lower(F.regexp_replace(carried, TAG, " "))
    runs = F.array_distinct(F.regexp_extract_all(kept, F.lit(f"[a-z]{{{min_len},}}"), F.lit(0)))

    # Bound once: inside the filter they would be built again for every term.
    def search(k: Column) -> Column:
        return bind(F.array_join(k, " "), lambda line: F.sort_array(F.filter(
            F.array_except(terms, k), lambda t: ~line.contains(t))))
    return bind(runs, search)


def demote_loss(ops: DataFrame, notes: DataFrame) -> DataFrame:
    """Adds `lost`: terms a demote would drop. `ops` has nid, into_nid, facts."""
    src = notes.select(F.col("nid").alias("_s"), F.col("text").alias("_st"),
                       F.col("extra").alias("_se"))
    dst = notes.select(F.col("nid").alias("_d"), F.col("text").alias("_dt"),
                       F.col("extra").alias("_de"))
    joined = (ops.join(src, ops["nid"] == F.col("_s")).join(dst, F.col("into_nid") == F.col("_d")))
    carried = F.concat_ws(" ", F.array_join("facts", " "), text("_de"), text("_dt"))
    body = F.concat_ws(" ", text("_st"), text("_se"))
    return joined.withColumn("lost", missing_terms(body, carried)).drop(
        "_s", "_st", "_se", "_d", "_dt", "_de")


# ---- J19..J24, E7 ---------------------------------------------------------------------------------

def merge_missing(state: DataFrame, template: DataFrame, keys: list[str]) -> DataFrame:
    """State plus the template records whose key it lacks; null keys are equal."""
    cond = None
    known = state.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    for k in keys:
        part = template[k].eqNullSafe(F.col(f"_{k}"))
        cond = part if cond is None else cond & part
    fresh = template.dropDuplicates(keys).join(known, cond, "left_anti")
    return state.withColumn("merged", F.lit(False)).unionByName(
        fresh.withColumn("merged", F.lit(True)), allowMissingColumns=True)


def upsert(registry: DataFrame, runs: DataFrame, key: str = "name") -> DataFrame:
    """Replace the fields of same-named records, keep their other fields, append the rest."""
    fresh = runs.select(F.col(key).alias("_k"), *[
        F.col(c).alias(f"_new_{c}") for c in runs.columns if c != key])
    both = registry.join(fresh, registry[key] == F.col("_k"), "full")
    columns = list(dict.fromkeys([*registry.columns, *runs.columns]))
    out = []
    for c in columns:
        if c == key:
            out.append(F.coalesce(registry[key], F.col("_k")).alias(key))
        elif c in runs.columns and c in registry.columns:
            out.append(F.when(F.col("_k").isNotNull(), F.col(f"_new_{c}"))
                       .otherwise(registry[c]).alias(c))
        elif c in runs.columns:
            out.append(F.col(f"_new_{c}").alias(c))
        else:
            out.append(registry[c])
    return both.select(*out)


def manifest_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, state) of expected files that are missing or altered."""
    have = actual.select(F.col("path").alias("_p"), F.col("sha256").alias("_sha"))
    state = (F.when(F.col("_p").isNull(), "missing")
             .when(F.col("_sha") != F.col("sha256"), "altered"))
    return (expected.where(F.col("sha256").isNotNull())
            .join(have, expected["path"] == F.col("_p"), "left")
            .select("path", state.alias("state")).where(F.col("state").isNotNull()))


def manifest_delta(old: DataFrame, new: DataFrame, present: DataFrame) -> DataFrame:
    """(path, change): retired, retained, and created for new paths not yet present."""
    o = _keys(old, "path", "path").withColumn("_o", F.lit(True))
    n = _keys(new, "path", "path").withColumn("_n", F.lit(True))
    p = _keys(present, "path", "path").withColumn("_p", F.lit(True))
    both = o.join(n, "path", "full").join(p, "path", "left")
    changes = F.array_compact(F.array(
        F.when(F.col("_o") & F.col("_n").isNull(), "retired"),
        F.when(F.col("_o") & F.col("_n"), "retained"),
        F.when(F.col("_n") & F.col("_p").isNull(), "created")))
    return both.select("path", F.explode(changes).alias("change"))


def report_lookup(modules: DataFrame, reports: DataFrame, name: str = "name") -> DataFrame:
    """Adds has_report and the newest report (last by file name)."""
    newest = reports.groupBy(F.col("module").alias("_m")).agg(
        F.max("report").alias("latest_report"))
    return (modules.join(newest, modules[name] == F.col("_m"), "left")
            .withColumn("has_report", F.col("_m").isNotNull()).drop("_m"))


def untracked_outputs(outputs: DataFrame, registry: DataFrame, folder: str = "folder",
                      name: str = "name") -> DataFrame:
    """Output folders whose name, in lower case, is not in the registry."""
    known = registry.select(F.lower(name).alias("_k")).distinct()
    return outputs.join(known, F.lower(outputs[folder]) == F.col("_k"), "left_anti")


def append_changelog(prior: DataFrame, new: DataFrame, run_id: str) -> DataFrame:
    """(carried, run_id, kind, nid, reason, seq): earlier entries that do not recur, then
    the new run's. Entries are equal when kind, note and reason are."""
    recur = new.select(F.col("kind").alias("_k"), F.col("nid").alias("_n"),
                       F.col("reason").alias("_r")).distinct()
    same = (F.col("kind").eqNullSafe(F.col("_k")) & F.col("nid").eqNullSafe(F.col("_n"))
            & F.col("reason").eqNullSafe(F.col("_r")))
    carried = prior.join(recur, same, "left_anti").withColumn("carried", F.lit(True))
    fresh = new.withColumn("run_id", F.lit(run_id)).withColumn("carried", F.lit(False))
    columns = ["carried", "run_id", "seq", "kind", "nid", "reason"]
    return carried.select(*columns).unionByName(fresh.select(*columns))


def changelog_union(prior: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct entries of both logs."""
    columns = ["kind", "nid", "reason"]
    return prior.select(*columns).unionByName(new.select(*columns)).distinct()


def populated_tails(notes: DataFrame) -> DataFrame:
    return notes.where(F.size(tail_populated()) > 0)


def blank_fields(notes: DataFrame, *fields: str) -> DataFrame:
    """One row: rows in total and blank values per field."""
    return notes.agg(F.count(F.lit(1)).alias("total"), *[
        F.count_if(is_blank(f)).alias(f"blank_{f}") for f in fields])
