"""Tables, files and generators that computations start from."""
