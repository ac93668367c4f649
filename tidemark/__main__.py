"""Commands over stores: create, ls, add, history, window, values, index, similar, sql, optimize, vacuum; and over memories: remember, recall."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions.predicates import literal
from tidemark.memory import Memory
from tidemark.operators.vectors import knn
from tidemark.session import local_session
from tidemark.sources.store import Store


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser("tidemark", description=__doc__)
    sub = p.add_subparsers(dest="verb", required=True)
    verb = {n: sub.add_parser(n) for n in ("create", "ls", "add", "history", "window", "values", "index", "similar", "sql", "optimize", "vacuum", "remember", "recall")}
    for v in verb.values():
        v.add_argument("store")
    for n in ("add", "history", "optimize", "vacuum", "values", "index", "similar"):
        verb[n].add_argument("table")
    verb["add"].add_argument("source", help="a CSV file or Parquet")
    verb["add"].add_argument("--ts", default="ts")
    verb["window"].add_argument("t0", help="nanoseconds, or +SECONDS from the store's first row")
    verb["window"].add_argument("t1", help="nanoseconds, or +SECONDS from the store's first row")
    verb["sql"].add_argument("query")
    for n in ("values", "index"):
        verb[n].add_argument("column")
    verb["values"].add_argument("value", nargs="+", help="numbers where the column has numbers")
    verb["similar"].add_argument("key", help="the column that names a row")
    verb["similar"].add_argument("vector", help="the column of vectors")
    verb["similar"].add_argument("name", help="the row whose like is sought")
    verb["remember"].add_argument("source", help="Parquet with recording and trace")
    verb["recall"].add_argument("recording")
    for n in ("similar", "recall"):
        verb[n].add_argument("-k", type=int, default=10)
    verb["optimize"].add_argument("--cluster")
    verb["vacuum"].add_argument("--keep", type=int, default=1)
    verb["vacuum"].add_argument("--dry-run", action="store_true")
    a = p.parse_args(args)
    spark = local_session()
    if a.verb == "create":
        Store.create(spark, a.store)
        return
    if a.verb in ("remember", "recall"):
        memory = Memory.open(spark, a.store)
        if a.verb == "remember":
            print(memory.add(spark.read.parquet(a.source)))
        else:
            memory.query_recording(a.recording, a.k).show(a.k, False)
        return
    store = Store.open(spark, a.store)
    if a.verb == "ls":
        store.describe().show(1000, False)
    elif a.verb == "add":
        print(store.ingest(a.table, a.source, a.ts).total("rows"))
    elif a.verb == "history":
        store.table(a.table).history().orderBy("version").show(1000, False)
    elif a.verb == "values":
        numbers = not isinstance(store.table(a.table).dataframe().schema[a.column].dataType, StringType)
        store.table(a.table).scan_values(a.column, [literal(v) if numbers else v for v in a.value]).show(1000, False)
    elif a.verb == "index":
        print(store.table(a.table).build_index(a.column).number)
    elif a.verb == "similar":
        rows = store.table(a.table).dataframe()
        own = rows.where(F.col(a.key) == a.name).select(a.vector).first()
        if own is None:
            raise KeyError(a.name)
        knn(rows.where(F.col(a.key) != a.name), a.vector, list(own[0]), a.k, a.key).select(a.key, "score", "rank").show(a.k, False)
    elif a.verb == "sql":
        store.sql(a.query).show(1000, False)
    elif a.verb == "optimize":
        if a.cluster:
            store.table(a.table).set_layout(a.cluster)
        print(len(store.table(a.table).compact().files))
    elif a.verb == "vacuum":
        print("\n".join(store.table(a.table).vacuum(a.keep, a.dry_run)))
    else:
        first = min(b.low for n in store.tables() for b in [store.table(n).version().bounds("ts")] if b.low is not None)
        at = lambda x: first + int(float(x) * 1e9) if x[0] == "+" else int(x)
        found, stats = store.window(at(a.t0), at(a.t1))
        for name, df in found.items():
            print(name, df.count())
        print(f"{stats.files_touched} of {stats.files_total} files, {stats.unread:.2f} % of the bytes left unread")


if __name__ == "__main__":
    main()
