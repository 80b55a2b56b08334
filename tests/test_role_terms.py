"""The terms of turns are made once, from turns that are dealt before."""

from statuta.plans import model_queries as M

DATA = "/root/testdata/sf0.001"


def test_terms_are_made_once(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(M.explain_terms(spark, DATA)).count("Generate") == 0
    made = plan(M._role_terms(spark, DATA))
    assert made.count("Exchange") == 1 and made.index("Generate") < made.index("Exchange")
