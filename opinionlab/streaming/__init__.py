"""The stateless operators and daily counts over streams."""
