"""Knowledge-graph analytics on Spark: text to chunks, propositions, entities and weighted graphs."""
