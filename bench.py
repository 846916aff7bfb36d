"""Headline timings: one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the local cores. Every query runs once to warm up and is
then timed; writes go to the shared folder (a fresh one per run).
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from larkseek import fixtures as X  # noqa: E402
from larkseek.functions import fulltext as FT  # noqa: E402
from larkseek.operators import changes as CH  # noqa: E402
from larkseek.operators import events as EV  # noqa: E402
from larkseek.operators import index as IX  # noqa: E402
from larkseek.operators import metrics as ME  # noqa: E402
from larkseek.plans import catalog as C  # noqa: E402
from larkseek.plans import typeahead as TA  # noqa: E402
from larkseek.session import get_session, shared_dir  # noqa: E402
from larkseek.sources import tables as TB  # noqa: E402
from larkseek.sources.item_store import ItemStore  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = get_session(f"local[{CPUS}]", CPUS, app="bench", spark__ui__enabled="false", spark__driver__memory="16g",
                        spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    base = f"{shared_dir(spark)}/bench-{uuid.uuid4().hex}"
    layout = f"{base}/layout"
    # driver tables are single files; spread their rows before the per-row text work
    items = C.item_table(spark, SF).repartition(CPUS * 2)

    def reindex():
        TB.write_search_layout(items, layout)

    def window_counts():
        TB.write_gram_stats(spark, layout)

    def distinct_queries(n: int = 1000):
        """``n`` different queries, first by hash (smaller data yields fewer)."""
        return X.customer_queries(spark, SF).select("query_id", "tenant_id", "q", "limit_per_group") \
            .unionByName(X.derived_queries(spark, SF)).dropDuplicates(["tenant_id", "q"]).orderBy(F.xxhash64("tenant_id", "q"), "tenant_id", "q").limit(n)

    def thousand_queries():
        run(TA.typeahead_batch(distinct_queries(), TB.read_search_layout(spark, layout), stats=TB.read_gram_stats(spark, layout)))

    def every_query():
        q = X.customer_queries(spark, SF).unionByName(C.all_queries(spark, SF))
        run(TA.typeahead_batch(q, TB.read_search_layout(spark, layout), stats=TB.read_gram_stats(spark, layout)))

    def event_merge():
        run(IX.apply_actions(items, EV.event_actions(X.contact_events(spark, SF).repartition(CPUS))))

    def event_store():
        store = ItemStore(spark, f"{base}/store-{uuid.uuid4().hex}").create()
        store.append_batch(EV.event_actions(X.contact_events(spark, SF).repartition(CPUS)), 0)
        run(store.current())

    def change_set():
        r = CH.apply_changes(X.contacts(spark, SF), X.contact_changes(spark, SF), "CONTACT", F.lit(X.DELETED).cast("timestamp"),
                             materialize_to=f"{base}/changes-{uuid.uuid4().hex}")
        run(r.snapshot)

    def document_vectors():
        docs = X.table(spark, SF, "documents").select("doc_id", "text").repartition(CPUS * 4)
        run(docs.select("doc_id", FT.tsvector([("text", "A")]).alias("tsv")))

    jobs = {
        "reindex": reindex, "window_counts": window_counts, "typeahead_1000": thousand_queries, "typeahead_all": every_query,
        "event_merge": event_merge, "event_store": event_store, "change_set": change_set,
        "relation_check": lambda: run(C.QUERIES["listing_contact_link"](spark, SF)),
        "outbox_route": lambda: run(C.QUERIES["outbox_route"](spark, SF)),
        "latency_percentiles": lambda: run(ME.latency_percentiles(X.query_log(spark, SF))),
        "document_vectors": document_vectors,
    }
    times = {}
    for name, job in jobs.items():
        job()
        t = time.perf_counter()
        job()
        times[name] = round(time.perf_counter() - t, 3)
    n_items = TB.read_search_layout(spark, layout).count()
    n_queries = distinct_queries().count()
    n_all = X.customer_queries(spark, SF).unionByName(C.all_queries(spark, SF)).select("tenant_id", "q").distinct().count()
    n_events = X.contact_events(spark, SF).count()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(SF.rstrip("/")).removeprefix("sf"), "cpus": CPUS, "items": n_items,
        "distinct_queries": n_queries, "distinct_queries_all": n_all,
        "typeahead_queries_per_sec": round(n_queries / times["typeahead_1000"], 1),
        "reindex_items_per_sec": round(n_items / times["reindex"]), "events_per_sec": round(n_events / times["event_merge"])}))
    spark.stop()


if __name__ == "__main__":
    main()
