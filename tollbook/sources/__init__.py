"""Reading raw extracts, conforming them, and storing the star schema."""
