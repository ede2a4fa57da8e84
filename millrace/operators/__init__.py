"""DataFrame to DataFrame computations, for batch and streaming alike."""
