"""Fisher's exact test in SQL, for the queries that compare two samples."""

from __future__ import annotations

from .queries_edits import _IN


def fisher_sql(counts: str, keys: str) -> str:
    """p of Fisher's exact test in SQL, for rows (keys, n_1, n_2, all_1, all_2): the tables with the same margins that are as likely or less."""
    logs = "lgamma(all_1 + 1) - lgamma(x + 1) - lgamma(all_1 - x + 1) + lgamma(all_2 + 1) - lgamma(n_1 + n_2 - x + 1) - lgamma(all_2 - n_1 - n_2 + x + 1)"
    every = "unnest(range(greatest(0, n_1 + n_2 - all_2), least(all_1, n_1 + n_2) + 1))"
    return f"""SELECT {keys}, n_1, n_2, CASE WHEN all_1 = 0 OR all_2 = 0 OR n_1 + n_2 = 0 OR n_1 + n_2 = all_1 + all_2 THEN 1.0 ELSE least(1.0, sum(exp(l - whole)) FILTER (WHERE l <= seen + 1e-7)) END AS p FROM (
  SELECT *, {logs} AS l, {logs.replace('x', 'n_1')} AS seen, lgamma(all_1 + all_2 + 1) - lgamma(n_1 + n_2 + 1) - lgamma(all_1 + all_2 - n_1 - n_2 + 1) AS whole FROM (SELECT *, {every} AS x FROM ({counts}) AS c) AS d) AS e GROUP BY {keys}, n_1, n_2, all_1, all_2"""


#: Reads of both samples with an edit of each kind at each position, and all of the reference's reads.
BY_KIND = f"""SELECT r.ref_name, k.kind, CAST(i AS INT) AS pos, count(*) FILTER (WHERE t.sample = 'O') AS n_1, count(*) FILTER (WHERE t.sample = 'F') AS n_2, any_value(r.all_1) AS all_1, any_value(r.all_2) AS all_2
FROM (SELECT ref_name, count(*) FILTER (WHERE sample = 'O') AS all_1, count(*) FILTER (WHERE sample = 'F') AS all_2 FROM reads GROUP BY ref_name) AS r CROSS JOIN range(64) AS x(i) CROSS JOIN (VALUES ('insertion'), ('deletion'), ('substitution')) AS k(kind)
LEFT JOIN ({_IN}) AS t ON t.ref_name = r.ref_name AND t.pos = i AND t.kind = k.kind GROUP BY ALL"""


#: The same over all kinds.
BY_POSITION = BY_KIND.replace("r.ref_name, k.kind, ", "r.ref_name, ").replace(" CROSS JOIN (VALUES ('insertion'), ('deletion'), ('substitution')) AS k(kind)", "").replace(" AND t.kind = k.kind", "")
