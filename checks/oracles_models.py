"""What must hold of the fitted models, whatever they learned."""

from __future__ import annotations

from checks.oracles import FEATURES, SQL
from checks.oracles_splits import LABELLED, WINDOWS
from checks.oracles_telemetry import TELEMETRY
from wellspring.operators.models import KINDS, TASKS


def supports(label: str) -> str:
    return f"SELECT {label} AS label, count(*) AS support, TRUE AS sums_to_one, TRUE AS most_likely FROM sw WHERE split = 'test' GROUP BY 1"


SQL["random_forest_binary"] = f"WITH {LABELLED} {supports('binary_target')}"
SQL["random_forest_multiclass"] = f"WITH {LABELLED} {supports('multiclass')}"
SQL["feature_importance"] = f"""SELECT unnest(generate_series(1, {len(FEATURES)})) AS rank, TRUE AS falling,
  1.0::DOUBLE AS total, {len(FEATURES)} AS features"""
SQL["isolation_forest"] = f"""WITH {LABELLED} SELECT binary_target, count(*) AS support, TRUE AS in_range,
  TRUE AS share_as_asked FROM sw WHERE split = 'test' GROUP BY 1"""
SQL["model_comparison"] = " UNION ALL ".join(
    f"SELECT '{task}' AS task, '{model}' AS model, TRUE AS are_shares, {label == 'binary_target'} AS has_auc"
    for label, task in TASKS.items() for model in KINDS.values())
BY_WELL = f"""{WINDOWS}, w AS (SELECT DISTINCT well_id FROM win),
r AS (SELECT well_id, row_number() OVER (ORDER BY md5(well_id || '42'), well_id) AS r, count(*) OVER () AS n FROM w),
sw AS (SELECT win.*, CASE WHEN r <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM win JOIN r USING (well_id))"""
SQL["well_disjoint_evaluation"] = f"WITH {BY_WELL} " + " UNION ALL ".join(
    f"SELECT *, '{label}' AS task FROM ({supports(label)})" for label in TASKS)
SQL["scored_telemetry"] = f"""WITH {TELEMETRY} SELECT id, device_id AS well_id, TRUE AS status_fits, TRUE AS event_fits,
  TRUE AS confidence_fits, TRUE AS sums_to_one FROM tel"""
SQL["feature_tables"] = f"WITH {LABELLED} " + " UNION ALL ".join(
    f"SELECT '{name}' AS name, event_folder, count(*) AS windows, sum(raw_class) AS raw_classes, sum(binary_target) AS faults FROM sw WHERE {kept} GROUP BY event_folder"
    for name, kept in (("full", "TRUE"), ("train", "split = 'train'"), ("test", "split = 'test'")))
