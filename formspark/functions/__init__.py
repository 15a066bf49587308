"""Column functions: pure ``Column -> Column``, all inside whole-stage codegen."""
