"""Entity tables, events, queries and logs as views over the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkseek.session import spread

CREATED = "2024-01-01 00:00:00"
DELETED = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tenant(c: str) -> Column:
    return F.concat(F.lit("t"), (F.col(c) % 4).cast("string"))


def _audit(key: str, deleted_every: int) -> list[Column]:
    created = F.lit(CREATED).cast("timestamp")
    return [(F.col(key) % 3).alias("version"), created.alias("created_at"), created.alias("updated_at"),
            F.when(F.col(key) % deleted_every == 0, F.lit(DELETED).cast("timestamp")).alias("deleted_at")]


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.cast("string").alias("id"), _tenant("c_custkey").alias("tenant_id"), F.col("c_name").alias("full_name"),
        F.concat(F.replace(F.lower("c_name"), F.lit("#"), F.lit(".")), F.lit("@example.com")).alias("email"),
        F.when(k % 5 != 0, F.concat(F.lit("+48 "), k.cast("string"))).alias("phone"),
        F.col("c_mktsegment").alias("label"), *_audit("c_custkey", 17))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    n_contacts = table(spark, sf_dir, "customer").agg(F.count("*")).scalar()
    return table(spark, sf_dir, "part").select(
        k.cast("string").alias("id"), _tenant("p_partkey").alias("tenant_id"), F.col("p_name").alias("title"),
        F.col("p_type").alias("subtitle"), F.concat("p_brand", F.lit("-"), k.cast("string")).alias("mls_id"),
        F.col("p_retailprice").cast("decimal(19,2)").alias("price"), F.lit("USD").alias("currency"),
        (k % n_contacts).cast("string").alias("contact_id"), *_audit("p_partkey", 19))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    first_part = (table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
                  .agg(F.min("l_partkey").alias("part")))
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").join(first_part, "o_orderkey", "left").select(
        k.cast("string").alias("id"), _tenant("o_custkey").alias("tenant_id"),
        F.concat(F.lit("Order "), k.cast("string")).alias("title"), F.col("o_orderpriority").alias("subtitle"),
        F.col("o_totalprice").cast("decimal(19,2)").alias("total"), F.lit("USD").alias("currency"),
        F.col("o_orderstatus").alias("status"), F.lit(True).alias("visible"),
        F.col("o_custkey").cast("string").alias("contact_id"), F.col("part").cast("string").alias("listing_id"),
        *_audit("o_orderkey", 23))


def referrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, sf_dir, "supplier").join(nation, "s_nationkey", "left").select(
        F.col("s_suppkey").cast("string").alias("id"), _tenant("s_suppkey").alias("tenant_id"),
        F.col("s_name").alias("title"), F.col("n_name").alias("subtitle"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_brand", "p_type").distinct().select(
        F.concat("p_brand", F.lit("/"), "p_type").alias("id"), F.lit("t0").alias("tenant_id"),
        F.col("p_type").alias("title"), F.col("p_brand").alias("subtitle"))


def mailings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark texts, so titles can be long."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("id"), _tenant("item_id").alias("tenant_id"),
        F.col("text").alias("title"), F.lit(None).cast("string").alias("subtitle"))


def contacts_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts with missing, padded and duplicate e-mails."""
    k = F.col("id").cast("long")
    other = F.upper(F.concat(F.lit("customer."), F.lpad((k - 4).cast("string"), 9, "0"), F.lit("@example.com")))
    email = (F.when(k % 53 == 0, F.lit(None))
             .when((k % 59 == 0) & (k >= 4), other)
             .when(k % 29 == 0, F.concat(F.lit("  "), "email", F.lit(" ")))
             .otherwise(F.col("email")))
    return contacts(spark, sf_dir).withColumn("email", email)


def listings_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with missing MLS ids, untidy currencies and three-decimal prices."""
    k = F.col("p_partkey")
    raw = table(spark, sf_dir, "part").select(
        k.cast("string").alias("id"), (F.col("p_retailprice") + 0.005).cast("decimal(19,3)").alias("price"))
    n = F.col("id").cast("long")
    ccy = (F.when(n % 11 == 0, F.lit(None)).when(n % 13 == 0, F.lit("  ")).when(n % 17 == 0, F.lit(" usd "))
           .when(n % 41 == 0, F.lit("US1")).otherwise(F.col("currency")))
    return (listings(spark, sf_dir).drop("price").join(raw, "id")
            .withColumn("currency", ccy)
            .withColumn("mls_id", F.when(n % 31 != 0, F.col("mls_id"))))


def transactions_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with a legacy ``amount`` column, null totals and statuses, and orphan contacts."""
    n = F.col("id").cast("long")
    return (transactions(spark, sf_dir)
            .withColumn("amount", F.when(n % 3 == 0, (F.col("total") + 1).cast("decimal(18,2)")))
            .withColumn("total", F.when(n % 37 != 0, F.col("total")))
            .withColumn("status", F.when(n % 43 != 0, F.col("status")))
            .withColumn("contact_id", F.when(n % 47 == 0, F.lit("-1")).otherwise(F.col("contact_id"))))


def contact_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contact_records(spread(table(spark, sf_dir, "events"), "event_id"))


def contact_event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records as a file stream over the event table."""
    schema = table(spark, sf_dir, "events").schema
    return contact_records(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def contact_records(events: DataFrame) -> DataFrame:
    """Contact records from event rows: valid, invisible, blank, tombstone and malformed ones."""
    e, u = F.col("event_id"), F.col("user_id")
    kind = (F.when(e % 103 == 0, F.lit("ContactMerged")).when(F.col("event_type") == "signup", F.lit("ContactCreated"))
            .when(F.col("event_type") == "error", F.lit("ContactDeleted")).otherwise(F.lit("contactUpdated")))
    tenant = F.when(e % 41 == 0, F.lit(" ")).otherwise(F.concat(F.lit("t"), (u % 4).cast("string")))
    title = F.when(e % 29 == 0, F.lit(" \t")).otherwise(
        F.concat(F.lit("\t User "), u.cast("string"), F.lit(" "), "event_type", F.lit(" ")))
    # `visible` comes as a JSON boolean, as text, as a number, or not at all.
    shown = F.when(e % 31 == 0, F.lit("false")).otherwise(F.lit("true"))
    visible = (F.when(e % 37 == 0, F.lit("")).when(e % 7 == 0, F.concat(F.lit(',"visible":"'), shown, F.lit('"')))
               .when(e % 11 == 0, F.concat(F.lit(',"visible":'), F.when(e % 31 == 0, F.lit("0")).otherwise(F.lit("1"))))
               .otherwise(F.concat(F.lit(',"visible":'), shown)))
    body = F.to_json(F.struct(
        kind.alias("type"), tenant.alias("tenantId"), u.alias("contactId"), title.alias("title"),
        F.when(e % 5 != 0, F.col("event_type")).alias("subtitle"), ((e * 7919) % 1000003).alias("version")))
    whole = F.concat(F.substring(body, F.lit(1), F.length(body) - 1), visible, F.lit("}"))
    value = (F.when(e % 97 == 0, F.lit(None).cast("string"))
             .when(e % 101 == 0, F.concat(F.lit("{broken "), body)).otherwise(whole))
    return events.select(
        F.lit("contact.events.v1").alias("topic"), (u % 6).cast("int").alias("partition"), e.alias("offset"),
        F.concat(tenant, F.lit(":"), u.cast("string")).alias("key"), value.alias("value"))


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), _tenant("user_id").alias("tenant_id"),
        F.when(F.col("event_type") == "error", F.lit("error")).when(F.col("event_type") == "view", F.lit("empty"))
        .otherwise(F.lit("ok")).alias("result"),
        (F.col("value") * 10).alias("latency_ms"),
        F.concat(F.lit("find"), F.when(u % 2 == 0, F.lit("\t")).otherwise(F.lit(" ")), F.lit("user"), u.cast("string"),
                 F.lit("@example.com or +48 600 100 "), F.lpad((u % 1000).cast("string"), 3, "0"),
                 F.when(u % 7 == 0, F.lit(" " + "x" * 100)).otherwise(F.lit(""))).alias("q"))


# The hand-written queries of the test set; every tenant asks each of them.
QUERY_TEXTS = ["re wi", "red", "r", "ge", "customer", "ring small", "order 12", "brand#2", "%", "", "   ",
               "  Red   Widget ", "wi re", "b_lt", "economy red", "supplier", "nation_1", "5-low", "12", "brand 2 red"]


def constant_queries(spark: SparkSession) -> DataFrame:
    rows = [(i * 4 + t, f"t{t}", q, [5, 50, 0, 99][t]) for i, q in enumerate(QUERY_TEXTS) for t in range(4)]
    return spark.createDataFrame(rows, "query_id bigint, tenant_id string, q string, limit_per_group int")


def derived_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per tenant and distinct part name: first word plus two letters of the second."""
    name = F.split("p_name", " ")
    return (table(spark, sf_dir, "part")
            .groupBy(_tenant("p_partkey").alias("tenant_id"),
                     F.concat(name[0], F.lit(" "), F.substring(name[1], 1, 2)).alias("q"))
            .agg((F.min("p_partkey") + 1000).alias("query_id"))
            .select("query_id", "tenant_id", "q", F.lit(5).alias("limit_per_group")))


def customer_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per customer: its whole name in lower case, or, as while it is typed, the name up to
    its last letter or its last four."""
    k, name = F.col("c_custkey"), F.lower("c_name")
    typed = F.length(name) - F.when(k % 2 == 0, 0).when(k % 4 == 1, 1).otherwise(4)
    return table(spark, sf_dir, "customer").select(
        (F.lit(10_000_000_000) + F.col("c_custkey")).alias("query_id"), _tenant("c_custkey").alias("tenant_id"),
        F.substring(name, F.lit(1), typed).alias("q"), F.lit(5).alias("limit_per_group"))


def contact_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes on contacts: good and stale updates, deletes, undeletes, bulk deletes, and inserts
    (one per supplier, every tenth of them twice)."""
    c = contacts(spark, sf_dir)
    n = F.col("id").try_cast("long")
    even = (n % 2 == 0).cast("long")
    none = F.lit(None)

    def step(k: int, op: str, cond: Column, expected: Column, name: Column = none, label: Column = none) -> DataFrame:
        return c.where(cond).select(
            (n * 10 + k).alias("seq"), F.lit(op).alias("op"), "tenant_id", "id", expected.cast("long").alias("expected_version"),
            name.cast("string").alias("full_name"), F.when(name.isNotNull(), F.col("email")).alias("email"),
            none.cast("string").alias("phone"), label.cast("string").alias("label"))

    out = step(1, "update", n % 2 == 0, F.col("version"), F.concat("full_name", F.lit(" II")), F.lit("VIP"))
    out = out.unionByName(step(2, "update", n % 4 == 0, F.col("version"), F.lit("lost")))
    out = out.unionByName(step(3, "delete", n % 3 == 0, F.col("version") + even))
    out = out.unionByName(step(4, "undelete", (n % 17 == 0) & (n % 5 == 0), F.col("version") + even))
    out = out.unionByName(step(5, "bulk_delete", n % 13 == 0, none))
    s = referrals(spark, sf_dir)
    m = F.col("id").try_cast("long")
    s = s.withColumn("twice", m % 10 == 0)
    fresh = s.select("twice", (m * 10).alias("seq"), F.lit("insert").alias("op"), "tenant_id", F.concat(F.lit("s"), "id").alias("id"),
                     none.cast("long").alias("expected_version"), F.col("title").alias("full_name"),
                     F.lit("new@example.com").alias("email"), none.cast("string").alias("phone"), F.col("subtitle").alias("label"))
    again = fresh.where("twice").withColumn("seq", F.col("seq") + 1)
    return out.unionByName(fresh.drop("twice")).unionByName(again.drop("twice"))


def unique_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact updates that want each other's e-mails, in blocks of four contacts of a tenant (places
    0 to 3): place 2 takes a new one or, in odd blocks, that of place 3; then 1 takes what 2 had, 0
    what 1 had; 0 tries another one, which works if the first try did not; and 3 wants that one too."""
    k = F.col("id").cast("long")
    block, place = F.floor(k / 16), F.floor(k % 16 / 4)
    theirs = F.concat(F.lit("CUSTOMER."), F.lpad((k + 4).cast("string"), 9, "0"), F.lit("@example.com"))

    def fresh(n: Column) -> Column:
        return F.concat(F.lit("other"), n.cast("string"), F.lit("@example.com"))

    def step(number: int, at: int, email: Column) -> DataFrame:
        return contacts(spark, sf_dir).where(place == at).select(
            (k + number * 1_000_000_000_000).alias("seq"), F.lit("update").alias("op"), "tenant_id", "id", F.col("version").alias("expected_version"),
            "full_name", email.alias("email"), "phone", "label")

    steps = [step(1, 2, F.when(block % 2 == 0, fresh(k)).otherwise(theirs)), step(2, 1, theirs), step(3, 0, theirs),
             step(4, 0, fresh(k)), step(5, 3, fresh(k - 12))]
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out


def listing_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing updates: some keep the subtitle, some keep the price, some name a wrong version or lack
    a required field; transactions of unsupported kind included."""
    n = F.col("id").try_cast("long")
    return listings(spark, sf_dir).select(
        n.alias("seq"), F.when(n % 7 == 0, "undelete").otherwise("update").alias("op"), "tenant_id", "id",
        F.when(n % 23 == 0, F.lit(None)).otherwise(F.col("version") + (n % 5 == 0).cast("long")).alias("expected_version"),
        F.when(n % 29 != 0, F.concat("title", F.lit(" new"))).alias("title"),
        F.when(n % 2 == 0, F.lit("fresh")).alias("subtitle"), "mls_id",
        F.when(n % 3 != 0, F.col("price") + F.lit("0.005").cast("decimal(19,3)")).alias("price"),
        F.when(n % 3 != 0, F.lit(" eur ")).alias("currency"),
        F.when(n % 31 == 0, F.lit("nobody")).when(n % 2 == 0, F.col("contact_id")).alias("contact_id"))


def transaction_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five changes of one transaction: an update that gives some fields, a bulk delete, a delete
    that names the version after the update, an insert of a taken id, and changes without an id."""
    n, none = F.col("id").try_cast("long"), F.lit(None)
    t = transactions(spark, sf_dir)
    live = F.col("deleted_at").isNull()
    first = (F.col("version") + ((n % 5 != 0) & live).cast("long")).alias("expected_version")

    def step(k: int, op: str, cond: Column, expected: Column, **given: Column) -> DataFrame:
        return t.where(cond).select((n * 10 + k).alias("seq"), F.lit(op).alias("op"), "tenant_id", (none if k == 5 else F.col("id")).cast("string").alias("id"),
                                    expected.cast("long").alias("expected_version"), *[given.get(c, none).cast(kind).alias(c) for c, kind in (
                                        ("title", "string"), ("subtitle", "string"), ("total", "decimal(19,3)"), ("currency", "string"), ("status", "string"),
                                        ("contact_id", "string"), ("listing_id", "string"))])

    out = step(1, "update", n % 2 == 0, F.col("version") + (n % 5 == 0).cast("long"), title=F.when(n % 4 == 0, F.concat("title", F.lit(" new"))),
               total=F.when(n % 3 != 0, F.col("total") + F.lit("0.005").cast("decimal(19,3)")), currency=F.when(n % 3 != 0, F.lit(" eur ")), status=F.when(n % 7 == 0, F.lit("DONE")))
    out = out.unionByName(step(2, "bulk_delete", n % 13 == 0, none))
    out = out.unionByName(step(3, "delete", n % 4 == 0, first))
    out = out.unionByName(step(4, "insert", n % 17 == 0, none, title=F.col("title"), total=F.lit(1)))
    return out.unionByName(step(5, "insert", n % 19 == 0, none, title=F.col("title"), total=F.lit(1)))
