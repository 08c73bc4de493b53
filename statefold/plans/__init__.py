"""Plans that need whole sequences: the recurrent language model and what is built on it."""
