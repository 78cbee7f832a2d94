"""Answers an intent over a folder of tables: python -m wardline TABLES INTENT.json [--yaml FOLDER] [--patients N]

The intent is read as JSON from a file, or from standard input where it is ``-``. Concepts are resolved with
alias_to_canonical_df; trends are built from the events where the folder has no table of them. Prints the status, the
header of the evidence and the first patients with their evidence.
"""

import argparse
import json
import sys

from pyspark.errors import AnalysisException

from wardline.catalog import table
from wardline.operators.cohort import trends
from wardline.operators.concepts import Resolver, read_customs
from wardline.plans.compiler import Catalog, active
from wardline.plans.evidence import run
from wardline.session import local_session


def main(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="wardline", description=__doc__)
    p.add_argument("tables")
    p.add_argument("intent")
    p.add_argument("--yaml", help="folder of custom concepts")
    p.add_argument("--patients", type=int, default=10, help="patients to print")
    a = p.parse_args(argv)
    spark = local_session(app="wardline")
    t = lambda n: table(spark, a.tables, n)
    events, class_map = t("event_df"), active(t("term_concept_class_map_df"))
    try:
        made = t("trends_df")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        made = trends(events)
    catalog = Catalog(t("patient_df"), events, class_map, t("baselines_df"), made)
    resolver = Resolver(active(t("alias_to_canonical_df")), class_map, read_customs(a.yaml) if a.yaml else [])
    with sys.stdin if a.intent == "-" else open(a.intent, encoding="utf-8") as f:
        intent = json.load(f)
    answer = run("", catalog, resolver, lambda _: intent)
    out = {"status": answer.status, "message": answer.message, "text": answer.text, "mappings": answer.trace.get("mappings")}
    if answer.package:
        out |= answer.package.header
        out["patients"] = [{"id": r.id, "age": r.age, "sex": r.sex, "evidence": [json.loads(x) for x in r.evidence], "context": [json.loads(x) for x in r.context]} for r in answer.package.patients.orderBy("patient_id").limit(a.patients).collect()]
    print(json.dumps(out, indent=1, default=str))
    return 0 if answer.status == "ok" else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
