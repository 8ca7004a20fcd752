"""tidewatch: event, sensor and corpus analytics expressed as Spark plans."""
