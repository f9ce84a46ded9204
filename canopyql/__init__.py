"""canopyql: analytics over source trees and document collections, on Spark DataFrames."""
