"""Plans: the registered queries of the engine."""
