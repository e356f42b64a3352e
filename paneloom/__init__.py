"""paneloom: site-day panel analytics and corpus preparation as Spark DataFrame operators."""
