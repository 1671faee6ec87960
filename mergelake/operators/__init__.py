"""The parts of the table layer: log, merge operators, schema rules, filters, vectors."""
