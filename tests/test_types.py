"""Every query's Spark schema has the same column types as its DuckDB oracle (names and widths)."""

import __spark_entry__ as E
from freshlane.oracle.compare import duck_connection

SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
                 "timestamp": "TIMESTAMP WITH TIME ZONE"}
STREAMS = {"stream_site_visits", "stream_actuals", "stream_daily_metrics"}  # run a stream to get a schema


def test_schemas_match_oracle(spark, sf_small):
    con = duck_connection(sf_small)
    qs, sq = E.queries(), E.oracle_sql()
    bad = {}
    for k, sql in sq.items():
        if k in STREAMS:
            continue
        st = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString().upper())
              for f in qs[k](spark, sf_small).schema.fields}
        rel = con.sql(sql)
        dt = {c: str(t).upper() for c, t in zip(rel.columns, rel.types)}
        if st != dt:
            bad[k] = {c: (st.get(c), dt.get(c)) for c in set(st) | set(dt) if st.get(c) != dt.get(c)}
    assert not bad, bad
