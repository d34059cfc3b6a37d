"""Reports over the wide table and the weekly KPI table."""
