"""Pools against plain loops."""

import re

from spindrift.operators import gates
from spindrift.plans import queries as Q
from spindrift.plans.binding import Tables


def loop(jobs, terms):
    norm = lambda x: " ".join(re.findall("[0-9a-zåäö]+", (x or "").lower()))
    texts = [(j, f" {norm(f'{t or str()} {d or str()}')} ") for j, t, d in jobs]
    phrases = [(p, norm(x)) for p, x in terms]
    return {(j, p) for j, text in texts for p, x in phrases if x and f" {x} " in text}


def test_discovery_pool(spark):
    jobs = [(1, "Senior Data engineer", "Works in Oulu."), (2, None, "data, engineer of things"), (3, "engineering", None), (4, None, None), (5, "of things", "no"), (6, "a", "things no")]
    terms = [(1, "data engineer"), (1, "Engineer"), (2, "of things no"), (2, "ENGINEER of"), (3, "!?"), (3, "oul"), (4, "oulu"), (4, "a things")]
    got = gates.discovery_pool(spark.createDataFrame(jobs, "job_id int, title string, description string"), spark.createDataFrame(terms, "profile_id int, term string"))
    found = [tuple(r) for r in got.select("job_id", "profile_id").collect()]
    assert len(found) == len(set(found)) and set(found) == loop(jobs, terms) and (5, 2) in found


def test_pool_of_all_profiles(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    some = t.job.where("job_id < 12")
    terms = [(r.profile_id, r.term) for r in Q.queries()["discovery_terms"](spark, t.folder).collect()]
    want = loop([(r.job_id, r.title, r.description) for r in some.collect()], terms)
    got = {(r.job_id, r.profile_id) for r in Q.queries()["pool_discovery"](spark, t.folder).where("job_id < 12").collect()}
    assert got == want and {p for _, p in got} - {0, 1, 2}
