"""The registry of queries and of their DuckDB twins."""

from pyspark.sql import functions as F

from cindergrid.sources.tables import table

Q, SQL = {}, {}


def query(sql):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f
    return add


def rows_only(f):
    """A query that SQL can't express; its tests compare it in other ways."""
    Q[f.__name__] = f
    return f


def rounded(df, *keep):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def both(name, sql):
    """A query whose text both engines read alike; its tables become views of the same names."""
    def run(s, d):
        for t in ("nation customer supplier part orders lineitem events labels documents embeddings").split():
            if f" {t}" in sql.replace("(", " "):
                table(s, d, t).createOrReplaceTempView(t)
        return s.sql(sql)
    Q[name], SQL[name] = run, sql
