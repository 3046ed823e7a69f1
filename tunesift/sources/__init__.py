"""Sources and sinks: test-table readers, catalogue fixtures, CSV/JSON/model IO."""
