"""tidewire: news-feed analytics expressed as Spark DataFrame plans."""
