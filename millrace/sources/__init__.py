"""Table loaders, file round trips and dataset cards."""
