from revgrain.functions import judging
from revgrain.operators import tools


def test_the_kind_of_a_field_is_found_once(spark):
    """Each comparison of a field's kind took the field and worked out its schema again, some forty times a judgment."""
    shown = spark.createDataFrame([("{}",)], "json string").select(judging.schema_errors("json").alias("e"))._jdf.queryExecution().analyzed().toString()
    assert shown.count("schema_of_variant") <= 7


def test_prompts_in_slices_keep_their_keys(spark):
    prompts = spark.createDataFrame([(k, f"p{k}" if k % 4 else None) for k in range(23)], "id long, prompt string").coalesce(1)
    got = {r.id: r for r in tools.call_model(prompts, "id", lambda texts: [t and t.upper() for t in texts], batch=5, retries=1).collect()}
    assert len(got) == 23 and all(r.raw == (f"P{k}" if k % 4 else None) and r.attempts == (1 if k % 4 else 2) for k, r in got.items())
