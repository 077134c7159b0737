"""Column builders: row-local expressions that stay inside whole-stage code generation."""
