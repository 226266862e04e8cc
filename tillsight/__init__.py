"""tillsight: retail sales analytics as lazy Spark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame; nothing is
collected to the driver. Results are keyed by ``user_id`` (the tenant), so
one job computes a view for all tenants at once; select a single tenant
with :func:`tillsight.operators.filters.tenant_sales` first when needed.
"""

__version__ = "0.1.0"
