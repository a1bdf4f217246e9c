"""Gates that hold back a comparison until upstream processing is complete."""
