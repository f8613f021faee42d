"""Log lines made from the event table, and what DuckDB reads from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_line() -> Column:
    """A line of an event: each eighth id is of another kind; some bars and endings share a line with another event."""
    f = F.format_string
    end = F.when(F.col("event_id") % 3 == 0, "CRASHED TWICE").otherwise("finished clean")
    bar = f("100%%|####| %d/%d [1:0%d:07<00:00,  1.7it/s", F.col("user_id"), F.col("user_id"), F.col("event_id") % 10)
    lines = [
        f("Train epoch: %d Learning rate: 0.0001", "user_id"),
        f("Instr s%d si_sdr: %.3f (Std: 1.000)", "user_id", "value"),
        f("Metric avg si_sdr     : %.3f", "value"),
        f("Training loss: 0.512 (over 39997 finite steps; %d non-finite skipped)", F.col("event_id") % 9),
        F.concat(bar, F.when(F.col("event_id") % 3 == 0, ", loss=nan]").otherwise(", loss=0.31]")),
        F.concat(F.when(F.col("event_id") % 7 == 0, F.concat(bar, F.lit("]"))).otherwise(""), f("=== run%d %s", F.col("user_id"), end)),
        f("step %d loss=nan", "event_id"),
    ]
    found = f("other %d", "event_id")
    for k, line in enumerate(lines):
        found = F.when(F.col("event_id") % 8 == k, line).otherwise(found)
    return found


_BAR = "'100%|####| ' || user_id || '/' || user_id || ' [1:0' || (event_id % 10) || ':07<00:00,  1.7it/s'"
#: l: the same lines; ev: their events, read with other patterns, a query a kind.
LINES_SQL = rf"""l AS (SELECT event_id, user_id, CASE event_id % 8 WHEN 0 THEN 'Train epoch: ' || user_id || ' Learning rate: 0.0001' WHEN 1 THEN 'Instr s' || user_id || ' si_sdr: ' || printf('%.3f', value) || ' (Std: 1.000)'
WHEN 2 THEN 'Metric avg si_sdr     : ' || printf('%.3f', value) WHEN 3 THEN 'Training loss: 0.512 (over 39997 finite steps; ' || (event_id % 9) || ' non-finite skipped)' WHEN 4 THEN {_BAR} || CASE WHEN event_id % 3 = 0 THEN ', loss=nan]' ELSE ', loss=0.31]' END
WHEN 5 THEN CASE WHEN event_id % 7 = 0 THEN {_BAR} || ']' ELSE '' END || '=== run' || user_id || ' ' || CASE WHEN event_id % 3 = 0 THEN 'CRASHED TWICE' ELSE 'finished clean' END WHEN 6 THEN 'step ' || event_id || ' loss=nan' ELSE 'other ' || event_id END AS line FROM events),
ev AS (SELECT event_id, user_id, 'epoch' AS kind, NULL::VARCHAR AS name, split_part(line, ' ', 3)::DOUBLE AS value, NULL::VARCHAR AS elapsed FROM l WHERE line LIKE 'Train %'
UNION ALL SELECT event_id, user_id, 'class_value', split_part(line, ' ', 2), split_part(line, ' ', 4)::DOUBLE, NULL FROM l WHERE line LIKE 'Instr %'
UNION ALL SELECT event_id, user_id, 'average', 'si_sdr', split_part(line, ': ', 2)::DOUBLE, NULL FROM l WHERE line LIKE 'Metric %'
UNION ALL SELECT event_id, user_id, 'non_finite', NULL, split_part(line, ' ', 8)::DOUBLE, NULL FROM l WHERE line LIKE '%skipped)'
UNION ALL SELECT event_id, user_id, 'bar', NULL, split_part(split_part(line, '/', 2), ' ', 1)::DOUBLE, split_part(split_part(line, '[', 2), '<', 1) FROM l WHERE line LIKE '100%'
UNION ALL SELECT event_id, user_id, 'nan_loss', 'nan', NULL, NULL FROM l WHERE line LIKE '%loss=nan%'
UNION ALL SELECT event_id, user_id, 'trailer', regexp_extract(line, '=== \S+ (.*)$', 1), NULL, NULL FROM l WHERE line LIKE '%=== %')"""
