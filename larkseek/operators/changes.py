"""Apply a table of changes to an entity table: optimistic locking, soft delete, emitted events.

``changes`` has ``seq, op (insert | update | delete | undelete | bulk_delete), tenant_id, id,
expected_version`` and the entity's columns (null = not given). ``seq`` orders the changes.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from larkseek.functions.money import rounded, valid_currency
from larkseek.functions.text import is_blank
from larkseek.operators.change_fold import make_fold
from larkseek.operators.events import bulk_delete_payload, outbox_rows
from larkseek.operators.reads import live_rows
from larkseek.session import shared_dir

KEY = ["tenant_id", "id"]
AUDIT = ["version", "created_at", "updated_at", "deleted_at"]


@dataclass(frozen=True)
class EntityRules:
    """How changes act on one entity."""
    name: str
    fields: tuple[str, ...]
    coalesced: frozenset[str] = frozenset()
    defaults: dict[str, str] = field(default_factory=dict)
    live_update: bool = True
    can_undelete: bool = False
    amount: str | None = None
    insert_required: tuple[str, ...] = ()
    update_required: tuple[str, ...] = ()


# Update rules, defaults and required fields of each entity.
CONTACT = EntityRules("CONTACT", ("full_name", "email", "phone", "label"), live_update=False, can_undelete=True,
                      insert_required=("full_name",), update_required=("full_name", "expected_version"))
LISTING = EntityRules("LISTING", ("title", "subtitle", "mls_id", "price", "currency", "contact_id"),
                      coalesced=frozenset({"subtitle", "mls_id", "price", "currency", "contact_id"}),
                      defaults={"price": "0.00", "currency": "USD"}, amount="price",
                      insert_required=("title", "mls_id", "contact_id", "price"),
                      update_required=("mls_id", "title", "expected_version", "price"))
TRANSACTION = EntityRules("TRANSACTION", ("title", "subtitle", "total", "currency", "status", "contact_id", "listing_id"),
                          coalesced=frozenset({"title", "subtitle", "total", "currency", "status", "contact_id", "listing_id"}),
                          defaults={"total": "0.00", "currency": "USD", "status": "NEW"}, amount="total",
                          insert_required=("title", "total", "contact_id", "listing_id"),
                          update_required=("title", "total", "expected_version"))
RULES = {r.name: r for r in (CONTACT, LISTING, TRANSACTION)}


@dataclass(frozen=True)
class ChangeResult:
    """``outcomes`` has one row per change with ``reject_reason`` (null = accepted) and the row as it
    stands after the change; the other frames derive from it."""
    outcomes: DataFrame
    snapshot: DataFrame
    rejected: DataFrame
    accepted: DataFrame


def validate_changes(changes: DataFrame, entity: str) -> DataFrame:
    """Add ``invalid``: the first missing required field of an insert or update, or a currency that
    is not three letters, or null."""
    rules = RULES[entity]
    reason = None
    for op, required in (("insert", rules.insert_required), ("update", rules.update_required)):
        for c in required:
            text = dict(changes.dtypes)[c] == "string" and not c.endswith("_id") or c == "mls_id"
            missing = (F.col("op") == op) & (is_blank(c) if text else F.col(c).isNull())
            value = F.lit(f"missing_{c}")
            reason = F.when(missing, value) if reason is None else reason.when(missing, value)
    if "currency" in rules.fields:
        bad = F.col("op").isin("insert", "update") & ~valid_currency(F.upper(F.trim("currency")))
        reason = F.when(bad, "invalid_currency") if reason is None else reason.when(bad, "invalid_currency")
    return changes.withColumn("invalid", reason)


def validate_relations(changes: DataFrame, entity: str, contacts: DataFrame, listings: DataFrame) -> DataFrame:
    """Add ``bad_relation``: a named contact or listing that is not live in the tenant, or a listing
    that belongs to another contact. Listing inserts and updates and transaction updates are checked."""
    ops = ["insert", "update"] if entity == "LISTING" else ["update"]
    c = live_rows(contacts).select("tenant_id", F.col("id").alias("contact_id"), F.lit(True).alias("_c"))
    checked = F.col("op").isin(ops)
    out = changes.join(c, ["tenant_id", "contact_id"], "left")
    bad_contact = checked & F.col("contact_id").isNotNull() & F.col("_c").isNull()
    reason = F.when(bad_contact, "contact_missing")
    if entity == "TRANSACTION":
        li = live_rows(listings).select("tenant_id", F.col("id").alias("listing_id"), F.col("contact_id").alias("_link"),
                                        F.lit(True).alias("_l"))
        out = out.join(li, ["tenant_id", "listing_id"], "left")
        reason = (reason.when(checked & F.col("listing_id").isNotNull() & F.col("_l").isNull(), "listing_missing")
                  .when(checked & F.col("contact_id").isNotNull() & F.col("listing_id").isNotNull()
                        & ~F.col("_link").eqNullSafe(F.col("contact_id")), "listing_not_linked"))
    return out.withColumn("bad_relation", reason).select(*changes.columns, "bad_relation")


def assign_ids(changes: DataFrame) -> DataFrame:
    """Random ids for inserts without one. Write the result before using it twice: a second
    evaluation draws other ids."""
    return changes.withColumn("id", F.when((F.col("op") == "insert") & F.col("id").isNull(), F.uuid()).otherwise(F.col("id")))


def _prepared(changes: DataFrame, rules: EntityRules, now: Column) -> DataFrame:
    """Only the needed columns, money normalised (null stays null)."""
    cols = [F.col(c) for c in ("seq", "op", *KEY, "expected_version")]
    for f in rules.fields:
        if f == rules.amount:
            cols.append(rounded(f).alias(f))
        elif f == "currency":
            cols.append(F.upper(F.trim(f)).alias(f))
        else:
            cols.append(F.col(f) if f in changes.columns else F.lit(None).cast("string").alias(f))
    return changes.select(*cols, now.alias("_now"))


def _with_current(changes: DataFrame, current: DataFrame, rules: EntityRules) -> DataFrame:
    cur = current.select(*KEY, F.lit(True).alias("_exists"),
                         *[F.col(c).alias(f"cur_{c}") for c in (*rules.fields, *AUDIT)])
    return changes.join(cur, KEY, "left").withColumn("_exists", F.coalesce("_exists", F.lit(False)))


def _single(rows: DataFrame, rules: EntityRules) -> DataFrame:
    """Outcome of keys with exactly one change: plain column expressions."""
    dead = "cur_deleted_at is not null"
    unsupported = "op not in ('update', 'delete', 'undelete')" + ("" if rules.can_undelete else " or op = 'undelete'")
    guarded_dead = "op in ('update', 'delete')" if rules.live_update else "op = 'delete'"
    judged = rows.selectExpr("*", f"""case
        when op = 'insert' then if(_exists, 'duplicate_key', null)
        when not _exists then 'not_found'
        when op = 'bulk_delete' then if({dead}, 'not_live', null)
        when {unsupported} then 'unsupported_op'
        when not (cur_version <=> expected_version) or ({dead} and {guarded_dead}) then 'stale_version' end as reject_reason""")
    after = []
    for f in rules.fields:
        new = f"coalesce({f}, cur_{f})" if f in rules.coalesced else f
        default = f"coalesce({f}, '{rules.defaults[f]}')" if f in rules.defaults else f
        after.append(f"cast(case when reject_reason is not null then cur_{f} when op = 'insert' then {default} "
                     f"when op = 'update' then {new} else cur_{f} end as {dict(rows.dtypes)[f]}) as {f}")
    ok = "reject_reason is null"
    return judged.selectExpr(
        *KEY, "seq", "op", "expected_version", "reject_reason", *after,
        f"case when {ok} and op = 'insert' then 0L when {ok} then cur_version + 1 else cur_version end as version",
        f"if({ok} and op = 'insert', _now, cur_created_at) as created_at", f"if({ok}, _now, cur_updated_at) as updated_at",
        f"case when {ok} and op in ('delete', 'bulk_delete') then _now when {ok} and op in ('insert', 'undelete') then null "
        "else cur_deleted_at end as deleted_at")


def _several(rows: DataFrame, rules: EntityRules, like: DataFrame) -> DataFrame:
    """Outcome of keys with several changes: sorted and streamed, one key at a time.

    The rows are shuffled by a hash column and not by the key itself: that would be the partitioning of
    the joins before, so the shuffle would be left out, and adaptive execution, which sees no need
    of the fold for whole keys, might then read the joins' shuffles in pieces that part a key.
    """
    types = dict(rows.dtypes)
    from decimal import Decimal
    defaults = {f: Decimal(v) if types[f].startswith("decimal") else v for f, v in rules.defaults.items()}
    fold = make_fold(list(rules.fields), set(rules.coalesced), defaults, rules.live_update, rules.can_undelete,
                     to_arrow_schema(like.schema))
    return rows.drop("_n").repartition(F.xxhash64(*KEY)).sortWithinPartitions(*KEY, "seq").mapInArrow(fold, like.schema)


def _missing(rows: DataFrame, like: DataFrame) -> DataFrame:
    """Outcome of changes that name no row: rejected, with nothing to show."""
    known = {*KEY, "seq", "op", "expected_version"}
    return rows.select(*[(F.col(c) if c in known else F.lit("missing_id") if c == "reject_reason" else F.lit(None)).cast(like.schema[c].dataType).alias(c)
                         for c in like.columns])


#: Stands before the operation of a change that is refused whatever its row's state.
REFUSED = "refused:"


def change_outcomes(current: DataFrame, changes: DataFrame, entity: str, now: Column, refused: DataFrame | None = None) -> DataFrame:
    """One outcome row per change; a change without tenant or id is rejected as ``missing_id`` (give
    inserts theirs by :func:`assign_ids`), one that ``refused(seq, reason)`` names for that reason.

    Counting changes per key combines before the shuffle and carries the only change of a key along,
    so keys with one change, nearly all of them, never enter Python or a sort. The changes of other
    keys are ordered by nature, as each meets the row that the one before it left; they stream key
    by key, so every outcome, a rejected one too, shows the row as it stands then.
    """
    rules = RULES[entity]
    if refused is not None:
        changes = (changes.join(refused.select("seq", F.col("reason").alias("_no")), "seq", "left")
                   .withColumn("op", F.coalesce(F.concat(F.lit(REFUSED), "_no", F.lit(":"), "op"), "op")).drop("_no"))
    every = _prepared(changes, rules, now)
    keyed = F.col("tenant_id").isNotNull() & F.col("id").isNotNull()
    ready = every.where(keyed)
    one = F.struct(*[F.col(c) for c in ready.columns])
    per_key = ready.groupBy(*KEY).agg(F.count("*").alias("_n"), F.max_by(one, "seq").alias("_only"))
    single = _single(_with_current(per_key.where("_n = 1").select("_only.*"), current, rules), rules)
    many = _with_current(ready.join(per_key.where("_n > 1").select(*KEY, "_n"), KEY), current, rules)
    nameless = _missing(every.where(~keyed), single)
    out = single.unionByName(_several(many, rules, single)).unionByName(nameless)
    if refused is None:
        return out
    no, parts = F.startswith("op", F.lit(REFUSED)), F.split("op", ":")
    return out.withColumns({"reject_reason": F.when(no, parts[1]).otherwise(F.col("reject_reason")), "op": F.when(no, parts[2]).otherwise(F.col("op"))})


def apply_changes(current: DataFrame, changes: DataFrame, entity: str, now: Column,
                  materialize_to: str | None = None, refused: DataFrame | None = None) -> ChangeResult:
    """Fold a change set into an entity table.

    The outcomes are written once, and snapshot, rejects and events all derive from that one written
    table, so they always agree and the change set is read once. ``materialize_to`` names its path in
    the shared folder, after the batch, so that a retried batch overwrites itself; without it the path
    is a fresh one.
    """
    rules = RULES[entity]
    out = change_outcomes(current, changes, entity, now, refused)
    path = materialize_to or f"{shared_dir(current.sparkSession)}/outcomes-{uuid.uuid4().hex}"
    out.write.mode("overwrite").parquet(path)
    out = current.sparkSession.read.schema(out.schema).parquet(path)
    accepted = out.where("reject_reason is null")
    row = F.struct(*rules.fields, *AUDIT)
    fresh = accepted.groupBy(*KEY).agg(F.max_by(row, "seq").alias("_r")).select(*KEY, "_r.*")
    extra = [c for c in current.columns if c not in (*KEY, *rules.fields, *AUDIT)]
    if extra:
        fresh = fresh.join(current.select(*KEY, *extra), KEY, "left")
        fresh = fresh.withColumns({c: F.coalesce(c, F.lit(True)) for c in extra if c == "visible"})
    snapshot = (current.join(accepted.select(*KEY), KEY, "left_anti")
                .unionByName(fresh.select(*current.columns)))
    rejected = out.where("reject_reason is not null").select(*KEY, "seq", "op", "expected_version", "reject_reason")
    return ChangeResult(out, snapshot, rejected, accepted)


def change_events(accepted: DataFrame, entity: str, occurred_at: Column) -> DataFrame:
    """Outbox rows of accepted inserts, updates and deletes (an undelete emits nothing), plus the
    bulk-delete events."""
    verb = (F.when(F.col("op") == "insert", "Created").when(F.col("op") == "update", "Updated").otherwise("Deleted"))
    each = outbox_rows(accepted.where("op in ('insert', 'update', 'delete')"), entity, verb, occurred_at)
    bulk = bulk_delete_payload(entity, accepted.where("op = 'bulk_delete'").select(*KEY), occurred_at).withColumns({
        "occurred_at": occurred_at, "published": F.lit(False), "published_at": F.lit(None).cast("timestamp")})
    return each.unionByName(bulk)
