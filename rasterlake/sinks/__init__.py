"""Writers: image files and embedded originals as binary columns, one value per image."""
