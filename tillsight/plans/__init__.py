"""Composed plans: query catalog, oracle SQL, ETL, dashboard, forecast."""
