"""voxloom: audio recordings to queryable transcripts on Spark.

``sources`` find and decode files, ``functions`` are column and array functions, ``operators`` are DataFrame
transformations, ``plans`` put them together to jobs, ``streaming`` runs a job on a folder that grows.
"""
