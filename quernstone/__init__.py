"""quernstone: graph, basket and text analytics as declarative Spark plans."""
