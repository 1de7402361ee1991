"""fluvia: hydrological and geostatistical analytics as Spark DataFrame operators."""
