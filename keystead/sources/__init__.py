"""Sources and sinks: explicit schemas, no inference."""
