def native(df):
    """No Python, no loop over pairs in the plan."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return not any(bad in text for bad in ("Python", "Pandas", "Arrow", "NestedLoop", "Cartesian"))
