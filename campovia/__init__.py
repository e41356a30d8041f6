"""Territory analytics on Spark: cleaning, geocoding, clustering, routing and scheduling as DataFrame plans."""
