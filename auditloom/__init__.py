"""Set-oriented evidence-register and grounding audits on PySpark DataFrames."""
