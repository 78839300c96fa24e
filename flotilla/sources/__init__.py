"""Table bindings over the test data, upload readers and sinks."""
